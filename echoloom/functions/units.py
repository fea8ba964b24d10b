"""Units, identifiers, parsing and formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BIN_KHZ, WINDOW_MS


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def bins_to_khz(bins: Column, bin_khz: Column | float = BIN_KHZ) -> Column:
    """Exact: the width of a bin is a dyadic fraction."""
    return bins * (bin_khz if isinstance(bin_khz, Column) else F.lit(bin_khz))


def khz_to_bin(khz: Column, flavor: str = "canonical") -> Column:
    """Bins of 0 to 255. canonical: half to even, then limits; simulator: limits, then half up."""
    if flavor == "canonical":
        return clamp(F.bround(khz / BIN_KHZ), 0, 255).cast("int")
    return F.floor(clamp(khz / BIN_KHZ, 0.0, 255.0) + 0.5).cast("int")


def duration_to_windows(ms: Column, flavor: str = "canonical") -> Column:
    """Windows of 1.28 ms, one at least; rounding as in khz_to_bin."""
    windows = ms / WINDOW_MS
    return F.greatest(F.lit(1), F.bround(windows) if flavor == "canonical" else F.floor(windows + 0.5)).cast("int")


def normal_density(x: Column, mean: Column | float, sigma: Column | float, floor: float = 0.0) -> Column:
    mean, sigma = (c if isinstance(c, Column) else F.lit(c) for c in (mean, sigma))
    sigma = F.greatest(sigma, F.lit(floor)) if floor else sigma
    z = (x - mean) / sigma
    return F.exp(-0.5 * z * z) / (sigma * F.sqrt(2 * F.pi()))


def all_close(low: Column, high: Column) -> Column:
    """Equal within 1e-8 + 1e-5 of the second."""
    return F.abs(low - high) <= 1e-8 + 1e-5 * F.abs(high)


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of an ASCII string, as a long."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(16777619), F.lit(1 << 32)))


def parse_parameter(notes: Column) -> Column:
    """struct(name, value) of a note 'name=number'; ('', null) for anything else."""
    parts = F.split(notes, "=", 2)
    value = F.get(parts, F.lit(1)).try_cast("double")
    return F.when(value.isNotNull(), F.struct(F.get(parts, F.lit(0)).alias("name"), value.alias("value"))).otherwise(F.struct(F.lit("").alias("name"), F.lit(None).cast("double").alias("value")))


def short_number(value: Column) -> Column:
    """A number as %g shows it, for values of up to six digits."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def parameter_note(name: Column, value: Column) -> Column:
    return F.concat(name, F.lit("="), short_number(value))


def scenario_id(dataset: Column, case_type: Column, replicate: Column, name: Column | None = None, value: Column | None = None) -> Column:
    """dataset-case-0001, with the parameter's slug before the number in a sweep."""
    number = F.lpad(replicate.cast("string"), 4, "0")
    if name is None:
        return F.concat_ws("-", dataset, case_type, number)
    slug = F.concat(name, F.lit("-"), F.replace(short_number(value), F.lit("."), F.lit("p")))
    return F.concat_ws("-", dataset, case_type, slug, number)


def padded_id(prefix: str, number: Column, width: int) -> Column:
    """det-000001, track-0001; a longer number is not cut."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0")))


def short_track_label(track_id: Column, species: Column, n_chirps: Column) -> Column:
    """t0001/Pk/n12: the track's number, the species' initials and its chirps."""
    initials = F.array_join(F.transform(F.split(species, r"\s+"), lambda w: F.substring(w, 1, 1)), "")
    return F.concat(F.replace(track_id, F.lit("track-"), F.lit("t")), F.lit("/"), initials, F.lit("/n"), n_chirps.cast("string"))


def hours(ms: Column) -> Column:
    return ms / 3_600_000.0


def format_hours(ms: Column) -> Column:
    """7.50 h."""
    return F.format_string("%.2f h", hours(ms).cast("double"))


def format_clock(ms: Column) -> Column:
    """h:mm:ss of a time of recording."""
    s = F.floor(ms / 1000)
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), (s % 60).cast("long"))
