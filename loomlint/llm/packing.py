"""Best-fit packing of token pieces into sequences of a fixed capacity, by exact-complement hashing.

A document's ids (and a closing id) are cut only where they are longer than the capacity; the first piece is the short
one.  Packing works on the histogram of piece lengths, which has at most ``capacity`` rows at any corpus size: for each
length, longest first, the gap it leaves is looked up among single lengths, sums of pairs and sums of triples, and a
combination that fills the gap exactly is consumed as often as the available counts allow.  What finds no exact
complement is placed best-fit, longest first.  The result is a list of patterns with multiplicities; pieces are dealt
to pattern places by their rank among pieces of equal length, so no task or driver ever holds the pieces themselves.

Defined cases: a null text is an empty one (only the closing id); repeated rows are packed separately, each in a place
of its own; a text with a run of spaces that the fast encoder cannot take is encoded by the tokenizer's JSON; an empty
table gives an empty result; other columns of the input are not carried.  A string that names a special token of the
vocabulary is that token, as the tokenizer's defaults have it.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, batch, counted_classes, enumerated, literal_table, map_arrow, running_offsets

CAPACITY = 2048


@lru_cache(maxsize=4)
def encoder(path: str):
    """ids of a text by a vocabulary file: ranks (.tiktoken, special tokens from a JSON of that name) or a tokenizer's JSON,
    which give the same ids, or a sentence-piece model."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).encode
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    beside, special = Path(path).with_suffix(".json"), {}
    if beside.exists():  # rank files do not name special tokens
        special = {t["content"]: t["id"] for t in json.loads(beside.read_text("utf-8"))["added_tokens"]}
    ids = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        try:
            return ids.encode(text, allowed_special="all")
        except BaseException as e:  # its pattern gives up on very long runs of spaces; some versions raise a kind of their own
            if not (isinstance(e, ValueError) or type(e).__name__ == "PanicException") or not beside.exists():
                raise
            return encoder(str(beside))(text)

    return encode


def vocabulary() -> str:
    """The ranks of the byte-level vocabulary of 50k ids; encodes some five times as fast as its JSON."""
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, ids) of each piece; all but the first are full."""
    at, first = 0, len(ids) % capacity or capacity
    while at < len(ids):
        end = at + (first if at == 0 else capacity)
        yield at, ids[at:end]
        at = end


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and its ids if asked for."""
    schema = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema += [("ids", pa.list_(pa.int32()))] if with_ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or vocabulary())
        for b in batches:
            for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                    for n, (start, x) in enumerate(cut(ids, capacity)):
                        rows.append((doc_id, n, start, len(x), zlib.crc32(x.tobytes()), *([x.astype(np.int32)] if with_ids else [])))
                yield batch(schema, **{name: [r[i] for r in rows] for i, (name, _) in enumerate(schema)})

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, ddl)


class Sums:
    """Lengths that are still available, looked up by the sum that one, two or three of them must make."""

    def __init__(self, counts: np.ndarray):
        self.left = counts

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.left[gap] else None

    def pair(self, gap: int, most: int | None = None) -> tuple[int, ...] | None:
        """The pair with the longest first length, at most ``most``."""
        there = self.left[1:gap] > 0
        both = there & there[::-1]
        if gap % 2 == 0 and gap and both.size and self.left[gap // 2] < 2:
            both[gap // 2 - 1] = False
        found = np.flatnonzero(both[: (most or gap)]) + 1
        return (int(found[-1]), gap - int(found[-1])) if len(found) else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        for a in (np.flatnonzero(self.left[1 : max(1, gap - 1)])[::-1] + 1).tolist():
            self.left[a] -= 1
            rest = self.pair(gap - a, a)
            self.left[a] += 1
            if rest:
                return (a, *rest)
        return None

    def complement(self, gap: int) -> tuple[int, ...] | None:
        return self.single(gap) or self.pair(gap) or self.triple(gap) if gap else ()


def plan_packing(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences) that use up the histogram."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in lengths.items():
        left[length] = n
    sums, plan = Sums(left), []
    for a in range(capacity, 0, -1):
        while left[a]:
            left[a] -= 1
            rest = sums.complement(capacity - a)
            left[a] += 1
            if rest is None:
                break
            pattern = (a, *rest)
            times = min(int(left[x]) // pattern.count(x) for x in pattern)
            for x in pattern:
                left[x] -= times
            plan.append((pattern, times))
    return plan + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit, longest first, whole counts at a time: sequences with the same contents are one class."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    gaps: list[int] = []

    def put(gap: int, pattern: tuple[int, ...], n: int) -> None:
        if not open_[gap]:
            insort(gaps, gap)
        open_[gap].append((pattern, n))

    for length in (np.flatnonzero(left)[::-1]).tolist():
        n = int(left[length])
        while n:
            i = bisect_left(gaps, length)
            if i < len(gaps):
                gap = gaps[i]
                pattern, m = open_[gap].pop()
                if not open_[gap]:
                    gaps.pop(i)
                took = min(n, m)
                if m > took:
                    put(gap, pattern, m - took)
                put(gap - length, (*pattern, length), took)
                n -= took
            else:
                each = min(n, capacity // length)
                took = n // each
                put(capacity - each * length, (length,) * each, took)
                n -= took * each
    return [c for classes in open_.values() for c in classes]


def places(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, from rank, to rank, first sequence, offset): where pieces of each length go, by rank."""
    used: dict[int, int] = defaultdict(int)
    out, first = [], 0
    for pattern, n in plan:
        offset = 0
        for length in pattern:
            out.append((length, used[length], used[length] + n, first, offset))
            used[length] += n
            offset += length
        first += n
    return out


def pack(pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns, and a ``length`` of at most ``capacity``) with sequence_id and offset.

    Wholly equal pieces are one row with their number until they have their places.
    """
    classes = scratch.keep(counted_classes(pieces, "_copies"), "classes")
    histogram, most = {}, 0
    for length, n, copies in classes.groupBy("length").agg(F.sum("_copies"), F.max("_copies")).collect():  # at most `capacity` rows
        histogram[length], most = n, max(most, copies)
    if not histogram:
        return classes.drop("_copies").withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    table = literal_table(pieces.sparkSession, places(plan_packing(histogram, capacity)), "length bigint, lo bigint, hi bigint, first bigint, offset bigint")
    ranked = running_offsets(classes, "length", pieces.columns, "_copies", "_rank")
    # the places are bounded by the capacity: a few for each length and pattern class, whatever the number of pieces
    end = F.col("_rank") + F.col("_copies")
    met = ranked.join(F.broadcast(table), "length").where((F.col("_rank") < F.col("hi")) & (end > F.col("lo")))
    met = met.withColumns({"_lo": F.greatest("_rank", "lo"), "_hi": F.least(end, "hi")}).drop("_rank", "_copies")
    placed = enumerated(met, F.col("_lo"), F.col("_hi"), "_at", most)
    return placed.withColumn("sequence_id", F.col("first") + F.col("_at") - F.col("lo")).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "pack")
    return pack(token_pieces(docs, capacity, path=path), scratch, capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
