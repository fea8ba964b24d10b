"""Densities, their peaks and mixtures of all recordings at once, as aggregations of (recording, value, count) rows.

A round of k-means or of expectation-maximisation is one join of the counts with the models and one aggregation with
partial sums; models that have ended wait. A recording's counts are never one list: rows of different values lie in
different tasks. What is kept whole is bounded by the configuration: points of a grid, peaks on it, components of a model.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MixtureConfig
from ..scratch import stored

ROOT_2PI = math.sqrt(2 * math.pi)
#: Rounds in one job; the models are written and looked at after each job.
UNROLLED = 3
#: Points of a search for the least density between two means; canonical searches LEVELS times, each between neighbours of the last.
POINTS, LEVELS = 160, 4
_ID = ["_k", "config"]
_RUN = [*_ID, "start"]


def histogram_of(rows: DataFrame, value: str = "fme_khz", keys: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """Counts by value, finite ones only: all that a fit needs, combined before the shuffle."""
    finite = F.abs(value) < F.lit(math.inf)  # NaN counts as larger than infinity
    return rows.filter(finite).groupBy(*keys, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))


def _width(c: MixtureConfig) -> Column:
    total, sd = F.col("total"), F.col("sd")
    shrink = F.pow(total, F.lit(-0.2))
    if c.flavor == "web":
        sd = F.greatest(sd, F.lit(math.sqrt(1e-9)))
        if c.bandwidth == "silverman":
            between = F.col("q3") - F.col("q1")
            sd = 0.9 * F.least(sd, F.when(between > 0, between / 1.34).otherwise(sd))
        return F.greatest(F.lit(0.05), sd * shrink * c.scale)
    if c.bandwidth == "silverman":
        return F.pow(total * 0.75, F.lit(-0.2)) * c.scale * sd
    return (shrink if c.bandwidth == "scott" else F.lit(float(c.bandwidth))) * c.scale * sd


def _settings(hist: DataFrame, configs: list[MixtureConfig]) -> DataFrame:
    """A row for each recording of two or more values and each configuration: spread, kernel width, grid and limits."""
    v, n = F.col("value"), F.col("n")
    first = hist.groupBy("_k").agg(
        F.sum("n").cast("double").alias("total"), (F.sum(n * v) / F.sum(n)).alias("mean"), F.min(v).alias("lo"), F.max(v).alias("hi"),
        F.percentile(v, F.lit(0.25), n.cast("long")).alias("q1"), F.percentile(v, F.lit(0.75), n.cast("long")).alias("q3"),
    ).filter("total >= 2")
    off = hist.join(first.select("_k", "mean"), "_k").groupBy("_k").agg(F.sum(n * (v - F.col("mean")) * (v - F.col("mean"))).alias("squares"))
    each = first.join(off, "_k").withColumn("sd", F.sqrt(F.col("squares") / (F.col("total") - 1)))
    each = each.withColumn("flat", F.abs(F.col("lo") - F.col("hi")) <= 1e-8 + 1e-5 * F.abs("hi")).withColumn("pad", F.greatest(F.lit(0.5), (F.col("hi") - F.col("lo")) * 0.02))
    rows = [F.struct(F.lit(i).alias("config"), F.lit(c.flavor == "web").alias("web"), _width(c).alias("width"), F.lit(c.min_distance_khz).cast("double").alias("distance"), F.lit(float(c.prominence)).alias("prominence"),
                     F.lit(c.max_components).alias("most"), F.lit(c.grid).alias("size"), F.lit(c.n_init).alias("starts"), F.lit(c.seed).cast("long").alias("seed")) for i, c in enumerate(configs)]
    each = each.withColumn("_c", F.explode(F.array(*rows))).select("_k", "total", "sd", "lo", "hi", "flat", "pad", "_c.*")
    each = each.withColumn("a", F.col("lo") - F.col("pad")).withColumn("step", (F.col("hi") + F.col("pad") - F.col("a")) / (F.col("size") - 1))
    return each.withColumn("far", F.greatest(F.lit(1.0), F.rint(F.coalesce("distance", "width") / F.col("step"))))


def density_curves(hist: DataFrame, settings: DataFrame) -> DataFrame:
    """(_k, config, i, x, y): the kernel density at each point of each grid, summed over values before the shuffle."""
    x = F.col("a") + F.col("i") * F.col("step")
    z = (x - F.col("value")) / F.col("width")
    wide = hist.join(settings.filter("not flat").select(*_ID, "a", "step", "width", "total", "size"), "_k").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    part = wide.withColumn("x", x).withColumn("part", F.col("n") * F.exp(-0.5 * z * z) / (F.col("total") * F.col("width") * ROOT_2PI))
    return part.groupBy(*_ID, "i").agg(F.max("x").alias("x"), F.sum("part").alias("y"))


def _tops(curves: DataFrame, web: bool) -> DataFrame:
    """Local maxima (i, y): the middle of a level top; web: a point above its left and not below its right neighbour."""
    along = Window.partitionBy(*_ID).orderBy("i")
    if not web:
        level = F.coalesce((F.col("y") != F.lag("y").over(along)).cast("int"), F.lit(0))
        runs = curves.withColumn("_new", level).withColumn("_run", F.sum("_new").over(along))
        curves = runs.groupBy(*_ID, "_run").agg(F.first("y").alias("y"), F.floor((F.min("i") + F.max("i")) / 2).cast("int").alias("i"))
    near = curves.withColumn("_l", F.lag("y").over(along)).withColumn("_r", F.lead("y").over(along))
    return near.filter((F.col("y") > F.col("_l")) & ((F.col("y") >= F.col("_r")) if web else (F.col("y") > F.col("_r")))).select(*_ID, "i", "y")


def _thinned(tops: DataFrame, settings: DataFrame) -> DataFrame:
    """Of tops nearer than the distance the higher stays, highest first; the later of equal ones."""
    packed = tops.join(settings.select(*_ID, "far"), _ID).groupBy(*_ID).agg(F.first("far").alias("far"), F.sort_array(F.collect_list(F.struct("y", "i")), False).alias("_t"))
    near = lambda kept, p: F.exists(kept, lambda q: F.abs(q["i"] - p["i"]) < F.col("far"))
    kept = F.aggregate("_t", F.slice("_t", 1, 0), lambda kept, p: F.when(near(kept, p), kept).otherwise(F.concat(kept, F.array(p))))
    return packed.select(*_ID, F.inline(kept))


def _prominent(tops: DataFrame, curves: DataFrame, settings: DataFrame, web: bool) -> DataFrame:
    """Tops that rise enough over the higher of the lowest points on either side: as far as higher ground; web: as the next tops."""
    line = curves.select(*_ID, F.col("i").alias("j"), F.col("y").alias("h"))
    met = tops.join(line, _ID)
    up = F.col("h") > F.col("y")
    bounds = met.groupBy(*_ID, "i", "y").agg(F.max("h").alias("top"), F.max("j").alias("end"), F.max(F.when(up & (F.col("j") < F.col("i")), F.col("j"))).alias("_a"), F.min(F.when(up & (F.col("j") > F.col("i")), F.col("j"))).alias("_b"))
    if web:
        along = Window.partitionBy(*_ID).orderBy("i")
        bounds = bounds.withColumn("_a", F.lag("i").over(along)).withColumn("_b", F.lead("i").over(along))
    bounds = bounds.withColumn("_a", F.coalesce("_a", F.lit(0))).withColumn("_b", F.coalesce("_b", "end"))
    low = lambda a, b: F.min(F.when(F.col("j").between(F.col(a), F.col(b)), F.col("h")))
    rises = bounds.join(line, _ID).groupBy(*_ID, "i", "y", "top").agg((F.col("y") - F.greatest(low("_a", "i"), low("i", "_b"))).alias("rise"))
    return rises.join(settings.select(*_ID, "prominence"), _ID).filter("rise >= top * prominence").select(*_ID, "i", "y")


def density_peaks(curves: DataFrame, settings: DataFrame, web: bool) -> DataFrame:
    """(_k, config, i, y) of the peaks that count: canonical the highest few, web the leftmost few. Where a density is symmetric, its
    two middle points may differ by rounding alone, and either is the peak."""
    settings = settings.filter(F.col("web") == web)
    curves = curves.join(settings.select(*_ID), _ID, "left_semi")
    tops = _tops(curves, web)
    found = _thinned(_prominent(tops, curves, settings, web), settings) if web else _prominent(_thinned(tops, settings), curves, settings, web)
    order = Window.partitionBy(*_ID).orderBy(*([F.asc("i")] if web else [F.desc("y"), F.desc("i")]))
    return found.withColumn("_r", F.row_number().over(order)).join(settings.select(*_ID, "most"), _ID).filter("_r <= most").select(*_ID, "i", "y")


def _begin(curves: DataFrame, settings: DataFrame, flavors: set[bool]) -> DataFrame:
    """Settings with peaks, grid and density of each model, and the centres that it begins from."""
    peaks = reduce(DataFrame.unionByName, [density_peaks(curves, settings, web) for web in sorted(flavors)])
    lists = peaks.join(curves.select(*_ID, "i", "x"), [*_ID, "i"]).groupBy(*_ID).agg(F.sort_array(F.collect_list("x")).alias("peaks"))
    lines = curves.groupBy(*_ID).agg(F.max(F.struct("y", -F.col("i"), "x"))["x"].alias("highest"), F.sort_array(F.collect_list(F.struct("x", "y"))).alias("_g"))
    every = settings.join(lines, _ID, "left").join(lists, _ID, "left")
    none, lo = F.array().cast("array<double>"), F.array("lo")
    canonical = F.coalesce("peaks", F.array("highest"))
    every = every.withColumn("centres", F.when(F.col("flat"), lo).otherwise(canonical)).withColumn("peaks", F.when(F.col("flat"), lo).when(F.col("web"), F.coalesce("peaks", none)).otherwise(canonical))
    return every.withColumn("grid", F.when(F.col("flat"), lo).otherwise(F.col("_g.x"))).withColumn("density", F.when(F.col("flat"), F.array(F.lit(1.0))).otherwise(F.col("_g.y"))).withColumn("web", F.col("web") & ~F.col("flat")).drop("_g", "highest")


def _starts(begin: DataFrame) -> DataFrame:
    """A row a start: the first has the peaks as centres, each later one as many centres drawn evenly between the smallest and
    the largest value by a hash of seed, recording, configuration, start and place."""
    draw = lambda c, j: F.when(F.col("start") == 0, c).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.xxhash64("seed", "_k", "config", "start", j).bitwiseAND(2**53 - 1) / float(2**53))
    each = begin.withColumn("start", F.explode(F.sequence(F.lit(0), F.when(F.col("flat"), F.lit(0)).otherwise(F.col("starts") - 1))))
    k = F.size("m")
    each = each.select(*_RUN, "total", "sd", "web", F.array_sort(F.transform("centres", draw)).alias("m"))
    sigma = F.sqrt(F.greatest(F.col("sd") * F.col("sd"), F.lit(0.05)))
    web = F.pow(F.greatest(sigma / F.sqrt(k), F.lit(0.15)), F.lit(2.0))
    return each.select(*_RUN, "total", "web", "m", F.transform("m", lambda _: web).alias("v"), F.transform("m", lambda _: 1.0 / k).alias("w"), F.col("m").alias("c"), F.lit(-math.inf).alias("before"), F.lit(0).alias("rounds"), F.col("web").alias("done"))


_STATE = ["total", "web", "m", "v", "w", "c", "before", "rounds", "done"]
#: What is added to a component's mass, ten times the spacing of doubles at one.
_EPS = f"{10 * 2.0**-52!r}D"


def _round(hist: DataFrame, state: DataFrame, per_row: list[list[str]], sums: list[str], new: list[dict[str, str]]) -> DataFrame:
    """One round: columns of each value under each model, their sums by model, and the next state of models that go on.

    Each list of columns may use the one before. Expressions are texts, since a round has hundreds of them.
    """
    rows = hist.join(state, "_k")
    for columns in per_row:
        rows = rows.selectExpr("*", *columns)
    rows = rows.groupBy(*_RUN).agg(*[F.first(c).alias(c) for c in _STATE], *[F.expr(f"sum({c}) AS {c}") for c in sums])
    for columns in new[:-1]:
        rows = rows.selectExpr("*", *[f"{e} AS {c}" for c, e in columns.items()])
    return rows.selectExpr(*_RUN, *[f"if(done, {c}, {new[-1][c]}) AS {c}" if c in new[-1] else c for c in _STATE])


def _list(most: int, item: str) -> str:
    """An array of the item for each component of the model; the item names the component's place as @."""
    return f"slice(array({', '.join(item.replace('@', str(j)) for j in range(most))}), 1, size(m))"


def _each(most: int, *items: str) -> list[str]:
    return [item.replace("@", str(j)) for item in items for j in range(most)]


def _k_means(hist: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """One round of k-means; variances and weights are those of the assignment to the centres before they move."""
    away = _each(most, "abs(value - get(c, @)) AS l@")
    least = [f"least({', '.join(_each(most, 'l@'))}, double('infinity')) AS near"]
    # The first of equally near centres has the value.
    own = [f"CASE {' '.join(_each(most, 'WHEN l@ = near THEN @'))} END AS own"]
    parts = _each(most, "if(own = @, n, 0D) AS p@", "if(own = @, n * (value - get(c, @)), 0D) AS q@", "if(own = @, n * (value - get(c, @)) * (value - get(c, @)), 0D) AS r@")
    moved = {"moved": _list(most, "if(p@ > 0, get(c, @) + q@ / p@, get(c, @))")}
    near = {"still": "forall(zip_with(moved, c, (a, b) -> abs(a - b) <= 1e-10D + 1e-5D * abs(b)), t -> t) OR rounds >= 99"}
    spread = _list(most, f"(r@ - q@ * q@ / greatest(p@, 1e-300D)) / (p@ + {_EPS}) + 1e-6D")
    new = {"c": "if(still, c, moved)", "v": spread, "w": _list(most, f"(p@ + {_EPS}) / total"), "rounds": "rounds + 1", "done": "still"}
    return _round(hist, state, [away, least, own, parts], _each(most, "p@", "q@", "r@"), [moved, near, new])


def _maximise(hist: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """One round of expectation and maximisation. canonical: 1e-6 is added to variances; ends when the mean log-likelihood moves
    by less than 1e-3, after 100 rounds at most. web: sigma of 0.05 at least; relative change of 1e-5, 120 rounds."""
    logs = _each(most, "ln(get(w, @)) - 0.5D * ln(2 * pi() * get(v, @)) - 0.5D * (value - get(m, @)) * (value - get(m, @)) / get(v, @) AS l@")
    top = [f"greatest({', '.join(_each(most, 'l@'))}, double('-infinity')) AS top"]
    whole = [f"top + ln({' + '.join(_each(most, 'coalesce(exp(l@ - top), 0D)'))}) AS each"]
    shares = ["n * each AS now", *_each(most, "n * exp(l@ - each) AS p@")]
    moments = _each(most, "p@ * (value - get(m, @)) AS q@", "p@ * (value - get(m, @)) * (value - get(m, @)) AS r@")
    mass = f"if(web, greatest(p@, 1e-6D), p@ + {_EPS})"
    moved = {"moved": _list(most, f"if(web AND p@ < 1e-6D, get(m, @), (p@ * get(m, @) + q@) / {mass})")}
    move = "(get(moved, @) - get(m, @))"
    spread = f"greatest(r@ - 2 * {move} * q@ + {move} * {move} * p@, 0D) / {mass}"
    ended = "if(web, abs(now - before) < 1e-5D * greatest(1D, abs(now)) OR rounds >= 119, abs(now - before) < 1e-3D * total OR rounds >= 99)"
    new = {"m": "moved", "v": _list(most, f"if(web, greatest({spread}, {0.05**2}D), {spread} + 1e-6D)"), "w": _list(most, f"{mass} / total"), "before": "now", "rounds": "rounds + 1", "done": ended}
    return _round(hist, state, [logs, top, whole, shares, moments], ["now", *_each(most, "p@", "q@", "r@")], [moved, new])


def _until_done(hist: DataFrame, state: DataFrame, most: int, step) -> DataFrame:
    """Rounds of step until every model has ended. Ended models are kept apart, so each job works on the others only."""
    ended = [state.filter("done")]
    state = state.filter("not done")
    while not state.isEmpty():
        for _ in range(UNROLLED):
            state = step(hist, state, most)
        whole = stored(state)
        ended.append(whole.filter("done"))
        state = whole.filter("not done")
    return reduce(DataFrame.unionByName, ended)


def _thresholds(models: DataFrame) -> DataFrame:
    """(_k, config, thresholds): places of least density between neighbouring means."""
    pairs = models.filter("size(parts) > 1").select(*_ID, "web", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("j"))
    pairs = pairs.withColumn("a", F.element_at("parts", F.col("j"))["m"]).withColumn("b", F.element_at("parts", F.col("j") + 1)["m"])
    for level in range(LEVELS):
        place = lambda i: F.col("a") + (F.col("b") - F.col("a")) * i / (POINTS - 1)
        high = lambda x: F.aggregate("parts", F.lit(0.0), lambda s, c: s + c["w"] * F.exp(-0.5 * F.pow((x - c["m"]) / c["s"], F.lit(2.0))) / c["s"])
        pairs = pairs.withColumn("_i", F.array_min(F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda i: F.struct(high(place(i)).alias("y"), i.alias("i"))))["i"])
        pairs = pairs.withColumn("at", place(F.col("_i")) if level == 0 else F.when(F.col("web"), F.col("at")).otherwise(place(F.col("_i"))))
        pairs = pairs.withColumn("_a", place(F.greatest(F.lit(0), F.col("_i") - 1))).withColumn("b", place(F.least(F.lit(POINTS - 1), F.col("_i") + 1))).withColumn("a", F.col("_a"))
    return pairs.groupBy(*_ID).agg(F.sort_array(F.collect_list("at")).alias("thresholds"))


def _prepared(rows: DataFrame, configs: list[MixtureConfig], value: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Counts by value, and what each model begins with."""
    hist = stored(histogram_of(rows, value, (key,)).select(F.struct(key).alias("_k"), "value", F.col("n").cast("double").alias("n")))
    settings = stored(_settings(hist, configs))
    curves = stored(density_curves(hist, settings))
    return hist, stored(_begin(curves, settings, {c.flavor == "web" for c in configs}))


def densities(rows: DataFrame, configs: list[MixtureConfig] = [MixtureConfig()], value: str = "fme_khz", key: str = "recording_id") -> DataFrame:
    """Peaks, grid and density of each recording and configuration (numbered from 0), without a model."""
    return _prepared(rows, configs, value, key)[1].select(F.col("_k")[key].alias(key), "config", "peaks", "grid", "density")


def fit_models(rows: DataFrame, configs: list[MixtureConfig] = [MixtureConfig()], value: str = "fme_khz", key: str = "recording_id") -> DataFrame:
    """One model for each recording of two or more finite values and each configuration (numbered from 0).

    Columns: key, config, k, means (ascending), sigmas, weights, thresholds, peaks, grid, density, log_likelihood, start. Of the
    n_init starts that of the largest log-likelihood stays, the earlier of equal ones. A null key is a recording as others are.
    """
    hist, begin = _prepared(rows, configs, value, key)
    most = max(c.max_components for c in configs)
    state = _until_done(hist, _starts(begin), most, _k_means).withColumn("done", F.lit(False)).withColumn("rounds", F.lit(0))
    state = _until_done(hist, state, most, _maximise)
    part = F.array_sort(F.transform(F.arrays_zip("m", "v", "w"), lambda c: F.struct(c["m"].alias("m"), F.sqrt(c["v"]).alias("s"), c["w"].alias("w"))))
    best = state.groupBy(*_ID).agg(F.max_by(F.struct("m", "v", "w", "before", "start"), F.struct("before", -F.col("start"))).alias("_b")).select(*_ID, "_b.*")
    models = stored(best.withColumn("parts", part).join(begin.select(*_ID, "web", "peaks", "grid", "density"), _ID))
    found = models.join(_thresholds(models), _ID, "left")
    return found.select(
        F.col("_k")[key].alias(key), "config", F.size("parts").alias("k"), F.col("parts.m").alias("means"), F.col("parts.s").alias("sigmas"), F.col("parts.w").alias("weights"),
        F.coalesce("thresholds", F.array().cast("array<double>")).alias("thresholds"), "peaks", "grid", "density", F.col("before").alias("log_likelihood"), "start",
    )
