"""Makes this package importable by the Python workers of executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each Spark context.

    Executors need neither an installed package nor a shared folder for it. The archive is built in the driver's own
    temporary folder and Spark's file server deals it out.
    """
    context = spark.sparkContext
    if getattr(context, "_echoloom_shipped", False):
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="echoloom-ship-")) / "echoloom_sources.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(top.rglob("*.py")):
            out.write(source, f"{top.name}/{source.relative_to(top)}")
    context.addPyFile(str(archive))
    context._echoloom_shipped = True
