"""Corpora of source files: reading folders and tables, writing results, and a small corpus of our own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlint import schema

#: Our own snippets; each exercises what its comment says.
FIXTURES = [
    (1, "defmodule A do\n  def half(n), do: n * 3 div 2\nend"),  # infix operator
    (2, "defmodule B do\n  def odd(n), do: n % 2 == 1\nend"),  # percent sign as modulo
    (3, "defmodule C do\n  def eps, do: 2e-9\nend"),  # exponent without a decimal point
    (4, "defmodule D do\n  private defp go(x), do: x\nend"),  # stale modifier
    (5, "defmodule E do\n  @spec g(list(atom()) :: atom())\n  def g(x), do: hd(x)\nend"),  # misplaced parenthesis
    (6, "defmodule F do\n  def best(xs), do: Enum.sort(xs) |> hd()\nend"),
    (7, "defmodule G do\n  def t(xs), do: Enum.map(xs, &f/1) |> Enum.sum()\n  defp f(x), do: x\nend"),
    (8, "defmodule H do\n  def s(xs), do: Enum.max(xs) - Enum.min(xs)\nend"),
    (9, "defmodule I do\n  def ok(a, b), do: a + b\nend"),  # clean
]


def fixture_corpus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, f"fixture/{i}.ex", code) for i, code in FIXTURES], schema.SOURCE)


def read_folder(spark: SparkSession, path: str, pattern: str = "*.{ex,exs}") -> DataFrame:
    """A row for each file below ``path``; the id is a hash of the file's path."""
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    at = F.col("_metadata.file_path")
    return files.select(F.xxhash64(at).alias("source_id"), at.alias("path"), F.col("value").alias("code"))


def read_table(df: DataFrame, source_id: str, code: str, path: str | None = None) -> DataFrame:
    """Any table with an id and a text column as a corpus."""
    return df.select(F.col(source_id).cast("long").alias("source_id"), (F.col(path) if path else F.lit(None)).cast("string").alias("path"), F.col(code).alias("code"))


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    df.write.mode(mode).format(kind).save(path)


def lines(source: DataFrame) -> DataFrame:
    """source_id, line_no (from 1), text of every line, trailing empty lines included; a null text has no lines."""
    return source.select("source_id", F.posexplode(F.split("code", "\n", -1)).alias("_at", "text")).select("source_id", (F.col("_at") + 1).alias("line_no"), "text")


def joined(line: DataFrame) -> DataFrame:
    """source_id, code: lines put together again in order."""
    rows = line.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("_all"))  # of one file
    return rows.select("source_id", F.array_join(F.transform("_all", lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("code"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """source_id, op (removed or added), line_no, text of lines that differ at the same place.

    Lines are compared by place, so a corpus of any size is one join on (source_id, line_no).
    """
    a, b = lines(before).withColumnRenamed("text", "old"), lines(after).withColumnRenamed("text", "new")
    both = a.join(b, ["source_id", "line_no"], "full").where(~F.col("old").eqNullSafe(F.col("new")))
    pairs = F.array(F.struct(F.lit("removed").alias("op"), F.col("old").alias("text")), F.struct(F.lit("added").alias("op"), F.col("new").alias("text")))
    return both.select("source_id", "line_no", F.explode(pairs).alias("d")).select("source_id", "d.op", "line_no", "d.text").where("text is not null")
