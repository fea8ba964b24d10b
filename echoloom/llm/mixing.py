"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's documents share one rate of copies, target over size. Its whole part is given to each; the fraction is
rounded by pivotal sampling with sizes: two documents at a time, one's fraction falls and the other's rises so that their
words together stay, until one of them is 0 or 1 and done. The other goes on. Runs of at most FAN documents are folded
in a task and hand on one residual; residuals are folded in runs of FAN in turn, level by level, until each source has
one, which goes to the nearer end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, WORD, Scratch, free, table

#: Documents or residuals folded by one call. A source's documents are dealt to FAN classes of size and FAN buckets of each.
FAN = 64
BUCKETS = FAN * FAN
#: Rows alike in all that are made out of one count at a time.
CHUNK = 1 << 16
#: Copies of a source's words at most, weights of the sources in order, and the seed of all draws.
MOST, WEIGHTS, SEED = 3, (1, 2, 3), 7


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code-point order, null last, weigh `weights` in turn and share all words; a target stops at `most` times
    its source's size, and the rest is shared anew by weight. In ascending order of most * size / weight the sources at
    their limit come first, so one pass of running sums finds the level at which the others end. One row a source is
    sorted in one task, and nothing else.
    """
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    found = found.withColumn("_w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int")))
    found = found.withColumn("_limit", F.col("source_size") * F.lit(float(most))).withColumn("_level", F.col("_limit") / F.col("_w"))
    order = Window.orderBy("_level", F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    found = found.withColumn("_place", F.row_number().over(order))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    weight = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    found = found.withColumn("_share", left / weight)
    level = F.min_by(F.when(F.col("_level") >= F.col("_share"), F.col("_share")), F.when(F.col("_level") >= F.col("_share"), F.col("_place"))).over(every)
    return found.select("source", "source_size", F.least("_limit", F.col("_w") * F.coalesce(level, F.lit(0.0))).alias("target"))


def _draw(*columns: Column) -> Column:
    """A number in [0, 1) that the columns decide."""
    return (F.pmod(F.xxhash64(*columns, F.lit(SEED)), F.lit(1 << 52)) / F.lit(float(1 << 52))).cast("double")


_ITEM = "struct<doc_id:bigint,size:bigint,x:double>"
_DONE = "array<struct<doc_id:bigint,size:bigint,one:int>>"


def _fold(items: Column, level: int) -> Column:
    """struct(carry, done) of a run of struct(doc_id, size, x), each step one transfer between the carry and the next."""

    def item(of: Column, x: Column) -> Column:
        return F.struct(of["doc_id"].alias("doc_id"), of["size"].alias("size"), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)).alias("x"))

    def done(of: Column, one: Column) -> Column:
        return F.struct(of["doc_id"].alias("doc_id"), of["size"].alias("size"), one.cast("int").alias("one"))

    def step(state: Column, e: Column) -> Column:
        c = state["carry"]
        a, b = c["size"].cast("double"), e["size"].cast("double")
        rise, fall = F.least(1 - c["x"], e["x"] * b / a), F.least(c["x"], (1 - e["x"]) * b / a)  # of the carry, at most
        up = F.coalesce(_draw(c["doc_id"], c["size"], e["doc_id"], e["size"], F.lit(level)) < fall / F.nullif(rise + fall, F.lit(0.0)), F.lit(False))
        # the one that reaches its end is done; the other takes what is left
        carry_ends = F.when(up, 1 - c["x"] <= e["x"] * b / a).otherwise(c["x"] <= (1 - e["x"]) * b / a)
        other = item(e, F.when(up, e["x"] - rise * a / b).otherwise(e["x"] + fall * a / b))
        own = item(c, F.when(up, c["x"] + rise).otherwise(c["x"] - fall))
        ended = F.when(carry_ends, done(c, up)).otherwise(done(e, ~up))
        moved = F.struct(F.when(carry_ends, other).otherwise(own).alias("carry"), F.concat(state["done"], F.array(ended)).cast(_DONE).alias("done"))
        return F.when(c.isNull(), F.struct(e.cast(_ITEM).alias("carry"), state["done"].alias("done"))).otherwise(moved).cast(f"struct<carry:{_ITEM},done:{_DONE}>")

    start = F.struct(F.lit(None).cast(_ITEM).alias("carry"), F.array().cast(_DONE).alias("done"))
    return F.aggregate(items, start.cast(f"struct<carry:{_ITEM},done:{_DONE}>"), step)


def count_words(text: Column) -> Column:
    """Runs of a text without ASCII white space, none of null: each is made one letter, so no list of words is held."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), WORD + "+", "x")
    return F.char_length(F.translate(letters, SPACES, ""))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken (copies times size) of every document.

    size is the text's number of words; null and empty texts have none and take the whole part of their source's rate.
    A null source is one of its own. Rows that repeat a doc_id are documents each; a null doc_id is one like others.
    Draws depend on ids, sizes and a seed, so runs agree. An empty table gives no rows; further columns are ignored. Rows
    alike in id, source and size are counted before any shuffle and numbered when they part again, and are dealt to
    buckets by that number as well, so no bucket gets all rows of one id. A call folds FAN rows at most, and every level's
    result is written to the shared scratch folder.
    """
    scratch = Scratch(docs.sparkSession)
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), count_words(F.col("text")).cast("long").alias("size"))
    sizes = scratch.save(sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "sizes")
    targets = scratch.save(source_targets(sizes.select("source", (F.col("size") * F.col("n")).alias("size")), weights, most), "targets", 0)
    rows = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rows = rows.withColumn("rate", F.coalesce(F.col("target") / F.nullif(F.col("source_size").cast("double"), F.lit(0.0)), F.lit(0.0)))
    rows = rows.withColumn("whole", F.floor(F.col("rate") + 1e-9)).withColumn("x", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(CHUNK))))
    rows = rows.withColumn("again", F.explode(F.sequence("chunk", F.least(F.col("chunk") + CHUNK, "n") - 1)))
    open_ = (F.col("size") > 0) & (F.col("x") > 0)
    by_size = F.lit(FAN - 1) - F.least(F.lit(FAN - 1), F.floor(2 * F.log2(F.greatest("size", F.lit(1)))))  # the largest first
    dealt = by_size * FAN + F.pmod(F.xxhash64("doc_id", "again", F.lit(SEED + 1)), F.lit(FAN))
    rows = rows.withColumn("bucket", F.when(open_, dealt.cast("int")))
    closed = rows.filter("bucket is null").select("doc_id", "size", "source_size", "target", "whole", F.lit(0).alias("one"))
    inside = Window.partitionBy("source", "bucket").orderBy(F.xxhash64("doc_id", "again", F.lit(SEED + 2)), "doc_id", "size", "again")
    rows = rows.filter("bucket is not null").withColumn("place", F.row_number().over(inside) - 1)
    rows = rows.select("source", "source_size", "target", "whole", "bucket", "place", F.struct("doc_id", "size", "x").cast(_ITEM).alias("item"))
    folded, level, parts = None, 0, [closed]
    in_bucket, buckets = None, BUCKETS
    while True:
        if level:
            rows = folded.select("source", "source_size", "target", "whole", "bucket", F.col("run").alias("place"), F.col("fold.carry").alias("item"))
        if level and in_bucket <= 1:  # each bucket has one residual: fold the buckets' own
            buckets = -(-buckets // FAN)
            rows = rows.withColumn("place", F.pmod("bucket", F.lit(FAN))).withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("int"))
        runs = rows.groupBy("source", "bucket", F.floor(F.col("place") / FAN).cast("int").alias("run"))
        firsts = [F.first(c).alias(c) for c in ("source_size", "target", "whole")]
        runs = runs.agg(*firsts, F.sort_array(F.collect_list(F.struct("place", "item"))).alias("items"))  # FAN rows at most
        runs = runs.withColumn("fold", _fold(F.transform("items", lambda i: i["item"]), level)).drop("items")
        folded = scratch.save(runs, f"level{level}")
        parts.append(folded.select("source_size", "target", "whole", F.explode("fold.done").alias("d")).select("d.doc_id", "d.size", "source_size", "target", "whole", "d.one"))
        if level == 0:
            in_bucket = (folded.agg(F.max("run")).first()[0] or 0) + 1
        else:
            in_bucket = -(-in_bucket // FAN)
        level += 1
        if in_bucket <= 1 and buckets == 1:
            break
    last = folded.select("fold.carry.*", "source_size", "target", "whole").select("doc_id", "size", "source_size", "target", "whole", (F.col("x") >= 0.5).cast("int").alias("one"))
    found = last
    for part in parts:
        found = found.unionByName(part)
    copies = (F.col("whole") + F.col("one")).cast("long")
    return found.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """The documents of the mix: each as often as its copies say, with all its columns; those with none are left out.

    Rows that repeat a doc_id (or, without one, a text) share the copies decided for them as evenly as whole numbers
    allow. Decisions are joined and rows numbered in the same dealing by that key, so a text is shuffled once.
    """
    key, total, rows, row, times, copy = (free(n, docs) for n in ("mix_key", "mix_copies", "mix_rows", "mix_row", "mix_times", "mix_copy"))
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))
    decided = mix(keyed.select(F.col(key).alias("doc_id"), "source", "text"), weights, most)
    decided = decided.groupBy(F.col("doc_id").alias(key)).agg(F.sum("copies").alias(total), F.count("*").alias(rows))
    order = Window.partitionBy(key).orderBy(F.xxhash64("text"))
    placed = keyed.join(decided, key).withColumn(row, F.row_number().over(order))
    share = F.floor(F.col(total) / F.col(rows)) + (F.col(row) <= F.col(total) % F.col(rows)).cast("int")
    placed = placed.withColumn(times, share.cast("int")).filter(F.col(times) > 0)
    return placed.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
