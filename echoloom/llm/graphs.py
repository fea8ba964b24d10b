"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, scratch: Scratch, name: str = "star") -> DataFrame:
    """(a, b) for every node a that is linked to a smaller one: b is the smallest node it can reach.

    Alternating large-star and small-star passes turn each component into a star around its smallest node; the number
    of passes grows with the logarithm of the longest chain. Minima are combined before the shuffle, and each pass is
    written to the shared scratch folder, so both sides of its join are plain shuffles that can be split where a node
    has very many links.
    """
    rows = edges.count()
    kept = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}0", rows)
    state, step = _state(kept), 0
    while state[0]:
        step += 1
        both = kept.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(kept.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}m{step}", rows)
        large = scratch.save(both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), f"{name}l{step}", rows)
        small = scratch.save(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}s{step}", rows)
        joined = large.join(small, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = scratch.save(joined.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), f"{name}{step}", rows)
        for old in (f"{name}m{step}", f"{name}l{step}", f"{name}s{step}", f"{name}{step - 1}"):
            scratch.drop(old)
        kept, before, state = after, state, _state(after)
        if state == before:
            break
    return kept
