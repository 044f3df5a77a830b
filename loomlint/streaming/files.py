"""Files as they arrive: a stream of sources, and its issues.

Every source is judged alone, so the stream has no state and needs no watermark; each file is read once, and the sink's
checkpoint makes that exact over restarts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomlint.operators.analysis import analyze


def watch_folder(spark: SparkSession, path: str, pattern: str = "*.{ex,exs}", files_per_batch: int = 1000) -> DataFrame:
    """A streaming table of sources: one row for each file that comes into the folder."""
    files = (
        spark.readStream.format("text")
        .schema("value string")
        .option("wholetext", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", str(files_per_batch))
        .load(path)
    )
    at = F.col("_metadata.file_path")
    return files.select(F.xxhash64(at).alias("source_id"), at.alias("path"), F.col("value").alias("code"))


def write_issues(source: DataFrame, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append the issues of a stream of sources to a Parquet folder."""
    writer = analyze(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
