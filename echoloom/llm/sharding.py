"""Rendezvous (highest random weight) sharding of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Hexadecimal digits of the key's hash that name the bucket of a shard in which rows are numbered: 4096 buckets, a
#: million narrow rows each in a table of 10**11 documents.
BUCKET_DIGITS = 3
#: Slots of rows alike in all that are written out together.
RUN = 65_536


def _draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that this key and this shard decide: 52 bits of an MD5."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit(str(shard)))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, that wins the key. A shard of weight w wins a share of w / sum(weights).

    Each shard's score depends on the key and that shard alone, so a shard added later takes only the keys that it
    wins and moves no other. A null key counts as the string 'null'. A tie goes to the lower shard.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above zero")
    key = F.coalesce(key.cast("string"), F.lit("null"))
    scores = [F.struct((-F.log(_draw(key, s)) / F.lit(float(w))).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"]


def number_slots(rows: DataFrame, shard: str, keys: Sequence[str], digits: int = BUCKET_DIGITS, run: int = RUN) -> DataFrame:
    """Add slot: 0, 1, 2, ... without gaps in each shard.

    Rows that are alike in all columns are counted first, before any shuffle, and written out again in runs of `run`
    slots once their place is known, so a row that is repeated however often is one row in every window. The different
    rows are numbered inside buckets of their shard by the hash of all keys, in the keys' order; the buckets' counts (at
    most 16 to the power of digits for each shard) shift them, and no task holds a whole shard.
    """
    kept = rows.columns
    hashed = F.md5(F.concat_ws(":", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys)))
    alike = rows.groupBy(*kept).agg(F.count("*").alias("_n")).withColumn("_bucket", F.substring(hashed, 1, digits))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.withColumn("_bucket", F.substring(hashed, 1, digits)).groupBy(shard, "_bucket").agg(F.count("*").alias("_n"))
    counts = counts.select(shard, "_bucket", F.coalesce(F.sum("_n").over(earlier(Window.partitionBy(shard).orderBy("_bucket"))), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_n").over(earlier(Window.partitionBy(shard, "_bucket").orderBy(*keys))), F.lit(0))
    placed = alike.withColumn("_inside", inside).join(F.broadcast(counts), [shard, "_bucket"])
    placed = placed.select(*kept, (F.col("_before") + F.col("_inside")).alias("_first"), "_n")
    runs = placed.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(run).cast("long"))))
    steps = F.sequence(F.lit(0).cast("long"), F.least(F.lit(run).cast("long"), F.col("_n") - F.col("_at")) - 1)
    return runs.withColumn("_step", F.explode(steps)).select(*kept, (F.col("_first") + F.col("_at") + F.col("_step")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * 16, grown: float = 1.0) -> DataFrame:
    """Shard documents by doc_id: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1. grown_shard is the shard with one more shard of weight `grown`: it equals
    shard or is the new one. Only numbers leave the scan; texts are never shuffled. A null text has size 1 and the
    checksum of an empty one; a null doc_id is the key 'null'; rows that repeat a doc_id share its shard and are
    numbered by checksum and size; an empty table gives no rows; further columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    weights = list(weights)
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), weights).alias("shard"),
        rendezvous(F.col("doc_id"), [*weights, grown]).alias("grown_shard"),
    )
    return number_slots(rows, "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
