"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A change is a row with a sign: +1 inserts a document's counts, -1 takes them back; a revised count is the old row with
-1 and the new one with +1, in one batch.  A batch is rolled up before it is written, so a batch costs its own size and
never that of the totals, and totals are sums of batches.

A batch commits under its id.  Its files count only when the writer's success marker is there: a batch that broke off
is written again, one that is committed is not applied twice, and a reader sees whole batches only.  ``compact`` folds
committed batches into a snapshot that names them.

Defined cases: null sources and languages are groups of their own; a null or empty text has 0 tokens and counts as a
document; repeated rows count each; groups whose documents and tokens are all zero are not in the totals; an empty
batch commits and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WORD, Scratch, batch, map_arrow
from .packing import encoder

#: Tokenizer versions that are plain expressions of the text.
NATIVE: Mapping[str, Callable[[Column], Column]] = {
    "words@1": lambda text: F.regexp_count(text, F.lit(WORD)),
    "bytes@1": F.octet_length,
}
#: Tokenizer versions of the query: plain ones, and vocabulary files.
VERSIONS: Mapping[str, Callable[[Column], Column] | str] = {
    **NATIVE,
    "byte_bpe_50k@1": public_tokenizers.path("byte_bpe_50k.tiktoken"),
    "piece_bpe_32k@1": public_tokenizers.path("piece_bpe_32k.model"),
}
KEYS = ["source", "lang", "tokenizer"]


def counted(docs: DataFrame, tokenizers: Mapping[str, Callable[[Column], Column] | str]) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens: a row for each document and tokenizer.

    A tokenizer is an expression of the text or the path of a vocabulary file.
    """
    text = F.coalesce("text", F.lit(""))
    native = {name: t(text) for name, t in tokenizers.items() if not isinstance(t, str)}
    files = {name: t for name, t in tokenizers.items() if isinstance(t, str)}
    out = None
    if native:
        pairs = F.array(*[F.struct(F.lit(name).alias("tokenizer"), n.cast("long").alias("tokens")) for name, n in native.items()])
        out = docs.select("doc_id", "source", "lang", F.explode(pairs).alias("p")).select("doc_id", "source", "lang", "p.*")
    if files:
        schema = [("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("tokenizer", pa.string()), ("tokens", pa.int64())]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for name, path in files.items():
                    encode = encoder(path)
                    tokens = np.array([len(encode(t)) for t in b.column("text").to_pylist()], np.int64)
                    yield batch(schema, doc_id=b.column("doc_id"), source=b.column("source"), lang=b.column("lang"), tokenizer=[name] * b.num_rows, tokens=tokens)

        some = map_arrow(docs.select(F.col("doc_id").cast("long"), "source", "lang", text.alias("text")), run, "doc_id long, source string, lang string, tokenizer string, tokens long")
        out = some if out is None else out.unionByName(some)
    return out


def rolled(changes: DataFrame) -> DataFrame:
    """Signed rows (source, lang, tokenizer, tokens, sign) to docs and tokens per group."""
    sign = F.col("sign").cast("long")
    return changes.groupBy(*KEYS).agg(F.sum(sign).alias("docs"), F.sum(sign * F.col("tokens")).alias("tokens"))


class Ledger:
    """Committed batches under ``path`` in the cluster's shared storage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _whole(self, folder: str) -> list[str]:
        root = self._at(f"{self.path}/{folder}")
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted(n for n in names if self._fs.exists(self._at(f"{self.path}/{folder}/{n}/_SUCCESS")))

    def _snapshot(self) -> tuple[str | None, set[str]]:
        found = self._whole("snapshots")
        if not found:
            return None, set()
        with_names = f"{self.path}/included/{found[-1]}"
        return found[-1], {r[0] for r in self.spark.read.schema("batch string").parquet(with_names).collect()}

    def committed(self) -> set[str]:
        return set(self._whole("batches")) | self._snapshot()[1]

    def commit(self, name: str, changes: DataFrame) -> bool:
        """Apply a batch of signed rows once; False if it was committed before."""
        if name in self.committed():
            return False
        rolled(changes).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.path}/batches/{name}")
        return True

    def totals(self) -> DataFrame:
        snapshot, included = self._snapshot()
        paths = [f"{self.path}/batches/{n}" for n in self._whole("batches") if n not in included]
        paths += [f"{self.path}/snapshots/{snapshot}"] if snapshot else []
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Fold all committed batches into a new snapshot; the list of what it holds is written first."""
        snapshot, included = self._snapshot()
        whole = included | set(self._whole("batches"))
        name = f"{int(snapshot) + 1 if snapshot else 0:012d}"
        totals = self.totals()
        self.spark.createDataFrame([(n,) for n in sorted(whole)], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/included/{name}")
        totals.write.mode("overwrite").parquet(f"{self.path}/snapshots/{name}")
        for n in self._whole("batches"):
            if n in whole:
                self._fs.delete(self._at(f"{self.path}/batches/{n}"), True)


def op3_token_counts(spark: SparkSession, sf_dir: str, tokenizers: Mapping[str, Callable[[Column], Column] | str] = VERSIONS) -> DataFrame:
    """Totals by source, language and tokenizer version (words, bytes, and tokens of two vocabularies) of all documents after inserts in 4 batches, a batch that takes a quarter back, its replay, and its revision."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    scratch = Scratch(spark, "counts")
    counts = scratch.keep(counted(docs, tokenizers).withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(4)), F.lit(0))), "counts")
    ledger = Ledger(spark, f"{scratch.root}/ledger")
    for part in range(4):
        ledger.commit(f"insert-{part}", counts.where(F.col("part") == part).withColumn("sign", F.lit(1)))
    taken = counts.where("part = 1")
    for _ in range(2):  # the replay changes nothing
        ledger.commit("delete-1", taken.withColumn("sign", F.lit(-1)))
    ledger.compact()
    ledger.commit("insert-2", counts.where("part = 2").withColumn("sign", F.lit(1)))  # nor does one after compaction
    # counts that were first put in one too high, and their revision in the same batch
    high, right = taken.withColumn("tokens", F.col("tokens") + 1), taken
    ledger.commit("again-1", high.withColumn("sign", F.lit(1)))
    ledger.commit("revise-1", high.withColumn("sign", F.lit(-1)).unionByName(right.withColumn("sign", F.lit(1))))
    return ledger.totals()


#: Of the rows of the plain tokenizer versions; vocabularies have no SQL form.
NATIVE_SQL = r"""
SELECT source, lang, 'words@1' AS tokenizer, count(*) AS docs, CAST(coalesce(sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))), 0) AS BIGINT) AS tokens
FROM documents GROUP BY source, lang
UNION ALL
SELECT source, lang, 'bytes@1', count(*), CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) FROM documents GROUP BY source, lang
"""
