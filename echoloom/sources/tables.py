"""Typed readers of truth tables, projects and stores of imported rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CLIP, DETECTION, TRUTH, struct

def read_truth_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRUTH).option("header", True).option("mode", "FAILFAST").csv(path)


def _fields(ddl: str) -> str:
    return ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in struct(ddl).fields)


def project_type() -> str:
    """The DDL of a project document: tracks, clips of both kinds, settings with a species mix, imported stores."""
    return (
        "schema_version int, id string, name string, duration_ms double, tracks array<struct<id:string,name:string,min_khz:double,max_khz:double>>, "
        f"clips array<struct<{_fields(CLIP)}>>, "
        "generation struct<duration_hours:double,density_per_hour:double,noise_level:double,echo_probability:double,activity_profile:string,species_mix:map<string,double>>, "
        f"imported_stores array<struct<store_id:string,bin_khz:double,rows:array<struct<{_fields(DETECTION)}>>>>"
    )


def read_project(spark: SparkSession, path: str) -> DataFrame:
    """Projects, a document each, from JSON."""
    return spark.read.schema(project_type()).option("multiLine", True).json(path)


def project_clips(projects: DataFrame) -> DataFrame:
    return projects.select(F.explode("clips").alias("c")).select("c.*")


def project_stores(projects: DataFrame) -> DataFrame:
    """Rows of the imported stores: store_id, bin_khz, row_idx and the detection."""
    stores = projects.select(F.explode("imported_stores").alias("s"))
    return stores.select("s.store_id", "s.bin_khz", F.posexplode("s.rows").alias("row_idx", "r")).select("store_id", "bin_khz", "row_idx", "r.*")


def load_project_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(project_type()).parquet(path)


class Store:
    """Imported rows by store, as a Parquet folder partitioned by store: add, look up, list, clear, drop unused ones."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.schema = f"bin_khz double, row_idx long, {DETECTION}, store_id string"

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def add(self, store_id: str, rows: DataFrame, bin_khz: float) -> None:
        """Rows in order of time; row_idx counts them from 0. A store of that id is replaced."""
        from pyspark.sql import Window

        order = Window.partitionBy("recording_id").orderBy("time_ms", "line_no")
        numbered = rows.withColumn("row_idx", (F.row_number().over(order) - 1).cast("long")).withColumn("bin_khz", F.lit(float(bin_khz)))
        mode = numbered.withColumn("store_id", F.lit(store_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        mode.partitionBy("store_id").parquet(self.path)

    def get(self, store_id: str) -> DataFrame:
        return self.rows().filter(F.col("store_id") == store_id).orderBy("row_idx")

    def get_range(self, store_id: str, start: int, end: int) -> DataFrame:
        """Rows start to end, end left out."""
        return self.get(store_id).filter((F.col("row_idx") >= start) & (F.col("row_idx") < end))

    def list(self) -> DataFrame:
        return self.rows().groupBy("store_id").agg(F.count("*").alias("n_rows"), F.first("bin_khz").alias("bin_khz"))

    def unused(self, clips: DataFrame) -> DataFrame:
        """Ids of stores that no clip refers to."""
        return self.rows().select("store_id").distinct().join(clips.select("store_id"), "store_id", "left_anti")

    def remove_unused(self, clips: DataFrame) -> None:
        self._drop([r["store_id"] for r in self.unused(clips).collect()])  # a list of ids

    def clear(self) -> None:
        self._drop([r["store_id"] for r in self.rows().select("store_id").distinct().collect()])

    def hydrate(self, projects: DataFrame) -> None:
        """Replace all stores by those of a project."""
        rows = project_stores(projects)
        rows.select("bin_khz", F.col("row_idx").cast("long").alias("row_idx"), *(f.name for f in struct(DETECTION).fields), "store_id").write.mode("overwrite").partitionBy("store_id").parquet(self.path)

    def _drop(self, ids: list[str]) -> None:
        jvm = self.spark.sparkContext._jvm
        for store_id in ids:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/store_id={store_id}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
