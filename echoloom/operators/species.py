"""Frequency ranges to species, first rule first, and mixture prediction as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.units import normal_density

# Fixed values: (low kHz, high kHz, label), both ends included, the first that fits.
LATIN_RULES = (
    (36.0, 39.0, "Pipistrellus kuhlii"),
    (42.0, 50.0, "Pipistrellus pipistrellus"),
    (52.0, 58.0, "Pipistrellus pygmaeus"),
    (24.0, 30.0, "Eptesicus serotinus"),
    (18.0, 24.0, "Nyctalus sp."),
    (10.0, 16.0, "Tadarida teniotis"),
)
# Fixed values of imported clips: common names, and a wider range of the noctule.
COMMON_RULES = (
    (36.0, 39.0, "Pipistrelle de Kuhl"),
    (42.0, 50.0, "Pipistrelle commune"),
    (52.0, 58.0, "Pipistrelle pygmee"),
    (24.0, 30.0, "Serotine commune"),
    (18.0, 26.0, "Noctule"),
    (10.0, 16.0, "Molosse de Cestoni"),
)
# Names of species by their ids, the one of unknown ids first.
SPECIES_NAMES = (("pip-kuhl", "Pipistrelle de Kuhl"), ("pip-common", "Pipistrelle commune"), ("pip-pygmy", "Pipistrelle pygmee"), ("serotine", "Serotine commune"), ("molosse", "Molosse de Cestoni"), ("noctule", "Noctule"))
UNKNOWN = "Indetermine"
# Bands of the timeline of a project, the first that fits, else the first.
BANDS = ((5.0, 24.0, "track-low"), (18.0, 42.0, "track-mid"), (36.0, 65.0, "track-high"))


def label(value: Column, rules: Sequence[tuple[float, float, str]] = LATIN_RULES, default: str | None = UNKNOWN) -> Column:
    """The label of the first range that holds the value; the default for none, null or NaN."""
    cases = reduce(lambda c, r: (c if c is not None else F).when(value.between(r[0], r[1]), F.lit(r[2])), rules, None)
    return cases.otherwise(F.lit(default))


def label_sql(value: str, rules: Sequence[tuple[float, float, str]] = LATIN_RULES, default: str | None = UNKNOWN) -> str:
    cases = " ".join(f"WHEN {value} BETWEEN {low} AND {high} THEN '{name}'" for low, high, name in rules)
    return f"CASE {cases} ELSE {'NULL' if default is None else repr(default)} END"


def band(value: Column, bands: Sequence[tuple[float, float, str]] = BANDS) -> Column:
    return label(value, bands, bands[0][2])


def component_densities(x: Column, means: Sequence[float], sigmas: Sequence[float], weights: Sequence[float]) -> list[Column]:
    return [w * normal_density(x, m, s) for m, s, w in zip(means, sigmas, weights)]


def mixture_density(x: Column, means: Sequence[float], sigmas: Sequence[float], weights: Sequence[float]) -> Column:
    return reduce(lambda a, b: a + b, component_densities(x, means, sigmas, weights))


def posterior(x: Column, means: Sequence[float], sigmas: Sequence[float], weights: Sequence[float]) -> Column:
    """Array of each component's share of the density."""
    parts = component_densities(x, means, sigmas, weights)
    total = reduce(lambda a, b: a + b, parts)
    return F.array(*(p / F.nullif(total, F.lit(0.0)) for p in parts))


def predict(x: Column, means: Sequence[float], sigmas: Sequence[float], weights: Sequence[float]) -> Column:
    """The component of largest log density, ties to the first."""
    from math import log

    scores = F.array(*(log(w) - log(s) - 0.5 * ((x - m) / s) * ((x - m) / s) for m, s, w in zip(means, sigmas, weights)))
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
