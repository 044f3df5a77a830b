"""Sessions: settings for local runs, and shipping this package to the Python workers of any cluster."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "6g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomlint")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_loomlint_shipped", False):
        return
    root = Path(__file__).resolve().parent
    # read by the driver alone, which serves it to the workers
    path = Path(tempfile.mkdtemp(prefix="loomlint-")) / "loomlint_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, Path(root.name, source.relative_to(root)))
    context.addPyFile(str(path))
    context._loomlint_shipped = True
