"""Exact linear quantiles of whole tables by selection on counts: no task sees more distinct values than a bound."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored

#: Parts of an interval that a round of counts tells apart, and distinct values that one task orders at last.
PARTS, BOUND = 1024, 4096
_TARGET = "t int, m int, rank long, lo double, hi double, before long"


def quantiles(rows: DataFrame, wanted: dict[str, tuple[Column, float]], bound: int = BOUND) -> dict[str, float | None]:
    """{name: quantile} of {name: (column, share)}; None where a column has no finite value. Nulls, NaN and infinities take no part.

    Rows are counted by value once, with partial sums. Each round counts the values of an interval by equal parts and goes on
    in the part that holds the rank, until it holds few distinct values; the driver keeps two ranks a quantile.
    """
    texts: dict[str, int] = {}
    place = {name: texts.setdefault(str(column._jc.toString()), len(texts)) for name, (column, _) in wanted.items()}
    columns = {place[name]: column for name, (column, _) in wanted.items()}
    pairs = F.array(*[F.struct(F.lit(m).alias("m"), column.cast("double").alias("v")) for m, column in columns.items()])
    counts = stored(rows.select(F.inline(pairs)).filter(F.abs("v") < F.lit(float("inf"))).groupBy("m", "v").agg(F.count("*").alias("n")))
    ends = {r.m: r for r in counts.groupBy("m").agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("d")).collect()}
    places = {name: share * (ends[place[name]].n - 1) for name, (_, share) in wanted.items() if place[name] in ends}
    ranks = sorted({(place[name], end(at)) for name, at in places.items() for end in (floor, ceil)})
    targets = {t: (m, rank, ends[m].lo, ends[m].hi, 0, ends[m].d) for t, (m, rank) in enumerate(ranks)}
    while wide := {t: v for t, v in targets.items() if v[5] > bound}:
        targets |= _narrowed(counts, wide)
    value = {ranks[t]: v for t, v in _ordered(counts, targets).items()} if targets else {}
    found: dict[str, float | None] = dict.fromkeys(wanted)
    for name, at in places.items():
        low, high = value[place[name], floor(at)], value[place[name], ceil(at)]
        found[name] = low if low == high else (1 - (at - floor(at))) * low + (at - floor(at)) * high
    return found


def _inside(counts: DataFrame, targets: dict[int, tuple]) -> DataFrame:
    """Counts in the interval of each target; the targets are literals of the plan, two a quantile."""
    own = F.array(*[F.struct(*[F.lit(x).cast(kind).alias(name) for (name, kind), x in zip((c.split() for c in _TARGET.split(", ")), (t, *v[:5]))]) for t, v in targets.items()])
    met = counts.withColumn("_t", F.explode(F.filter(own, lambda t: (t["m"] == F.col("m")) & F.col("v").between(t["lo"], t["hi"]))))
    return met.select("v", "n", "_t.t", "_t.rank", "_t.lo", "_t.hi", "_t.before")


def _narrowed(counts: DataFrame, targets: dict[int, tuple]) -> dict[int, tuple]:
    """Each target with the part of its interval that holds its rank; smallest and largest value lie in different parts."""
    width = F.col("hi") / PARTS - F.col("lo") / PARTS
    part = F.when(width > 0, F.least(F.floor((F.col("v") / PARTS - F.col("lo") / PARTS) / width * PARTS), F.lit(PARTS - 1))).otherwise((F.col("v") > F.col("lo")).cast("long"))
    parts = _inside(counts, targets).groupBy("t", "rank", "before", part.alias("part")).agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("d"))
    up_to = F.sum("n").over(Window.partitionBy("t").orderBy("part")) + F.col("before")
    held = parts.withColumn("up_to", up_to).filter("rank < up_to AND rank >= up_to - n")
    return {r.t: (targets[r.t][0], r.rank, r.lo, r.hi, r.up_to - r.n, r.d) for r in held.collect()}


def _ordered(counts: DataFrame, targets: dict[int, tuple]) -> dict[int, float]:
    """The value at the rank of each target, among at most the bound's distinct values."""
    up_to = F.sum("n").over(Window.partitionBy("t").orderBy("v")) + F.col("before")
    held = _inside(counts, targets).withColumn("up_to", up_to).filter("rank < up_to AND rank >= up_to - n")
    return {r.t: r.v for r in held.select("t", "v").collect()}
