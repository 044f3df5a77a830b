"""Helpers that the corpus operators share: written scratch tables, running offsets, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loomlint.session import ship_package

#: Used only in local mode, where the session names no spark.checkpoint.dir, as in tests.
LOCAL_SCRATCH = "/tmp/checkpoints/loomlint"
#: A table of at most so many slim rows (16 to 64 bytes each) may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Rows of a slim table for each file and task, where their number is known before.
FILE_ROWS = 50_000
#: The word pattern of all word-level operators, as Java, Python and RE2 read it.
WORD = r"[^\x20\x09-\x0D]+"


#: Arrow batches of texts are cut at so many bytes on their way to Python, for both sides hold them twice; a scan reads
#: so many rows at a time, for its vectors hold whole texts and are doubled when they grow.
BATCH_BYTES, SCAN_ROWS = 4 << 20, 128


#: Options of a write to a local file system.  Without native libraries Hadoop's usual one starts three chmod processes for
#: every file (for its task's folder, itself and its checksum file), and until such a process runs its program it has the
#: JVM's memory as its own.  This one writes no checksum files, so it starts two; Parquet's pages have checksums of their own.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits for Arrow batches to ``BATCH_BYTES``, and for rows of a scan's batch to ``SCAN_ROWS``."""
    for key, most, unit in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES, "b"), ("spark.sql.parquet.columnarReaderBatchSize", SCAN_ROWS, "")):
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or int(now) > most:
            spark.conf.set(key, f"{most}{unit}")


_SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_counts(texts: pa.Array) -> np.ndarray:
    """Number of words of each UTF-8 text (null: 0): places where a byte that is no space follows a space or begins a text."""
    texts = texts.cast(pa.binary())
    if not len(texts):
        return np.zeros(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    space = _SPACES[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data else np.zeros(0, bool)
    begins = ~space
    begins[1:] &= space[:-1]
    starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    some = starts[ends > starts]
    begins[some] = ~space[some]
    total = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
    return total[ends] - total[starts]


def with_sizes(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``size``, the number of words of the column ``text``, in its place as the last column."""
    keep = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(word_counts(b.column(text)), pa.int64())], names=[*keep, "size"])

    asked = rows.select(*keep, F.col(text).cast("binary").alias(text))
    return asked.mapInArrow(run, StructType([*asked.select(*keep).schema.fields, StructField("size", LongType())]))


class Scratch:
    """Tables written to the cluster's shared folder: they cut lineage and survive lost executors.

    ``keep`` writes a frame as Parquet and reads it again; ``drop`` removes a table no longer needed.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        ship_package(spark)
        small_batches(spark)
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = LOCAL_SCRATCH
        self.root = f"{root.rstrip('/')}/loomlint/{what}-{uuid.uuid4().hex}"
        own = spark._jsparkSession.sessionState().newHadoopConf().get("fs.file.impl")
        self.options = {} if own else PLAIN_FILES  # a class that the session names for local files stays

    def keep(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """``df``, written and read again; if it has ``rows`` slim rows at most, by as many tasks as these are worth."""
        if rows is not None and -(-rows // FILE_ROWS) < partitions(self.spark):
            df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
        path = f"{self.root}/{name}"
        conf, key = self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(key, "false")
        conf.set(key, "true")  # nothing reads the shuffle files of a finished write
        try:
            df.write.mode("overwrite").options(**self.options).parquet(path)
        finally:
            conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Remove all scratch tables of this package from the shared folder, once no result is read from them any more."""
    scratch = Scratch(spark, "clear")
    scratch.root = scratch.root.rsplit("/", 1)[0]
    scratch.drop("")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a slim table if its counted rows allow; else leave the join to the planner."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def literal_table(spark: SparkSession, rows: Sequence[Sequence], ddl: str) -> DataFrame:
    """A small driver-side table as a DataFrame, by JSON and SQL only."""
    import json

    names = [part.split()[0] for part in ddl.split(",")]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    return (
        spark.range(1)
        .select(F.explode(F.from_json(F.lit(text), f"array<struct<{', '.join(':'.join(p.split()) for p in ddl.split(','))}>>")).alias("r"))
        .select("r.*")
    )


#: Cells of a group that are ordered together: the window over cells has two levels, so that no task orders all of them.
CELLS_TOGETHER = 64
#: Copies of a row that are enumerated in one go; longer runs are cut, and dealt out again, before they are enumerated.
RUN = 10_000


def counted_classes(df: DataFrame, copies: str = "copies") -> DataFrame:
    """Wholly equal rows as one, with their number: partial counts meet before the shuffle, so copies never fill a task."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(copies))


def enumerated(df: DataFrame, first: Column, end: Column, out: str, longest: int) -> DataFrame:
    """A row for each integer from ``first`` up to ``end`` (excluded), as ``out``; no row spans more than ``longest``."""
    if longest <= RUN:
        return df.withColumn(out, F.explode(F.sequence(first, end - 1)))
    runs = df.withColumn("_end", end).withColumn("_run", F.explode(F.sequence(first, end - 1, F.lit(RUN).cast("long"))))
    dealt = runs.repartition(partitions(df.sparkSession), F.xxhash64(*df.columns, "_run"))
    return dealt.withColumn(out, F.explode(F.sequence("_run", F.least("_end", F.col("_run") + RUN) - 1))).drop("_end", "_run")


def running_offsets(df: DataFrame, group: str, order: Sequence[Column | str], weight: Column | str, out: str = "start") -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows that stand before a row in its group.

    Rows are ordered by a hash of ``order``, which is pseudorandom but fixed by the values.  A group of any size is cut
    into cells, which are ranges of that hash; so their number, which follows the rows and the session's partitions,
    does not change the order.  Rows alike in ``order`` and group share a cell: count them first (``counted_classes``)
    if there can be many.  ``df`` is read three times, so hand over a written table.  ``group`` must not be null.
    """
    spark = df.sparkSession
    width = partitions(spark)
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    groups, rows = counts.agg(F.count(F.lit(1)), F.sum("_n")).first()
    cell_rows = max(1, min(50_000, -(-(rows or 0) // (4 * width))))
    # 2^bits cells in a group, some cell_rows rows each
    bits = F.greatest(F.ceil(F.log2(F.col("_n") / F.lit(cell_rows))), F.lit(0)).cast("int")
    hashed = df.withColumn("_h", F.xxhash64(*order)).join(bounded(counts, groups), group).withColumn("_bits", bits).drop("_n")
    cell = F.when(F.col("_bits") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftright(_h, 64 - _bits)"))
    w = hashed.withColumn("_cell", cell).drop("_bits").withColumn("_w", F.lit(weight) if not isinstance(weight, str) else F.col(weight))
    sums = w.groupBy(group, "_cell").agg(F.sum("_w").alias("_sum")).withColumn("_some", F.floor(F.col("_cell") / F.lit(CELLS_TOGETHER)))
    up_to = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    some = sums.groupBy(group, "_some").agg(F.sum("_sum").alias("_all"))
    some = some.select(group, "_some", F.coalesce(F.sum("_all").over(up_to(group).orderBy("_some")), F.lit(0)).alias("_before"))
    base = sums.withColumn("_own", F.coalesce(F.sum("_sum").over(up_to(group, "_some").orderBy("_cell")), F.lit(0))).join(some, [group, "_some"])
    base = base.select(group, "_cell", (F.col("_before") + F.col("_own")).alias("_base"))
    ranked = w.withColumn("_in", F.coalesce(F.sum("_w").over(up_to(group, "_cell").orderBy("_h", *order)), F.lit(0)))
    return ranked.join(base, [group, "_cell"]).withColumn(out, (F.col("_base") + F.col("_in")).cast("long")).drop("_h", "_cell", "_w", "_in", "_base")


def grouped_batches(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Cut batches that are sorted by ``keys`` into tables that never split a key: all rows of a key come together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k) for k in keys]
        changed = np.zeros(batch.num_rows, bool)
        for c in cols:
            v = c.to_numpy(zero_copy_only=False)
            changed[1:] |= v[1:] != v[:-1]
        if held:
            last = held[-1]
            changed[0] = any(last.column(k)[last.num_rows - 1] != c[0] for k, c in zip(keys, cols, strict=True))
        cuts = np.flatnonzero(changed)
        if len(cuts):
            cut = int(cuts[-1])
            if held or cut:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


class Union:
    """Union-find over 0..n-1; the smaller index is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Connected components of undirected edges (a long, b long): node, root (the least node reachable).

    Alternating large-star and small-star steps; each writes its edges, so no step depends on an executor's memory.
    A hub's edges meet its minimum in a join of two written tables, which adaptive execution can split.  Nodes without
    an edge to another node are not in the result.
    """

    def least(directed: DataFrame, tag: str, most: int) -> tuple[DataFrame, DataFrame]:
        mins = scratch.keep(directed.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-{tag}", most)
        return mins, bounded(mins, mins.count())

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = scratch.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-0")
    was, turn, old = mark(e), 0, f"{name}-0"
    while was[0]:
        turn += 1
        most = 2 * was[0]  # a step makes no more rows than there are edges in both directions
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        _, mins = least(both, f"large-{turn}", most)
        large = both.join(mins, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(large, f"{name}-{turn}l", most)
        _, mins = least(large, f"small-{turn}", most)
        small = large.join(mins, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(mins.select(F.col("u").alias("a"), F.col("m").alias("b")))
        e = scratch.keep(small.where("a <> b").distinct(), f"{name}-{turn}", 2 * most)
        for gone in (old, f"{name}-{turn}l", f"{name}-large-{turn}", f"{name}-small-{turn}"):
            scratch.drop(gone)
        old, now = f"{name}-{turn}", mark(e)
        if now == was:
            break
        was = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def batch(schema: Sequence[tuple[str, pa.DataType]], **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[n], type=t) for n, t in schema], schema=pa.schema([pa.field(n, t) for n, t in schema]))
