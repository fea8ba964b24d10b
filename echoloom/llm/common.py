"""Shared helpers of the training-data operators: tables, scratch space, partition counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: A word, everywhere in this subpackage: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The ASCII white space between words.
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(df: DataFrame, mb: int = 64) -> int:
    """How many partitions a shuffle of df needs: the session's count, more where the plan's size asks for it."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size > 1 << 60 else max(least, min(size // (mb << 20), 200_000))


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow, with this package's sources sent to the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def in_ranges(rows: DataFrame, count: int, *keys: str) -> DataFrame:
    """rows dealt to count tasks by ranges of (keys, hash of text, place in the input) and sorted so in each.

    The hash parts rows that share their keys, however many, and the place parts rows that are alike in all: those can
    be exchanged, so results don't depend on their places. rows have the columns keys and text.
    """
    rows = rows.withColumn("_hash", F.xxhash64("text")).withColumn("_place", F.xxhash64(F.monotonically_increasing_id()))
    order = [*keys, "_hash", "_place"]
    return rows.repartitionByRange(count, *order).sortWithinPartitions(*order).drop("_hash", "_place")


def free(name: str, df: DataFrame) -> str:
    """name, or with more underscores before it, so that no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Narrow rows (a few numbers) that a task of a scratch table handles.
NARROW = 1_000_000


class Scratch:
    """Tables written to the folder that all machines share, to cut lineage.

    The folder is the one that spark.checkpoint.dir names. Only where the session names none (tests on one machine)
    is a temporary folder used. Files outlive a lost executor, unlike cached or locally checkpointed blocks.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            root = tempfile.mkdtemp(prefix="echoloom-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.root = f"{root.rstrip('/')}/echoloom-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, rows: int | None = None, **options: str) -> DataFrame:
        """Write df under a name of this scratch space and return the table read back.

        rows, where a bound of narrow rows is known, keeps a small table from being dealt over many tasks and files.
        """
        df = df if rows is None else df.coalesce(max(8, rows // NARROW))
        df.write.mode("overwrite").options(**options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str | None = None) -> None:
        """Delete one table, or all."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def prefix_sums(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """(key, sum of value over all smaller keys). For tables of a row per task only: one task sorts them."""
    from pyspark.sql import Window

    order = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return df.groupBy(key).agg(F.sum(value).alias(value)).select(key, F.coalesce(F.sum(value).over(order), F.lit(0)).cast("long").alias(out))
