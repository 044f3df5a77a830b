"""Near copies by the Jaccard similarity of their sets of shingles.

Fingerprints a few bits apart catch texts that are nearly identical; an edited copy at similarity 0.8 is some ten of 64
bits away.  Candidates come from MinHash: ``BANDS`` buckets of ``ROWS`` minima each (a pair at 0.8 shares none of them
twice in a million), and every candidate pair is verified by the exact similarity of its sets.

Equal texts are one class.  Only buckets with company of another fingerprint are looked into, buckets with the same
members once; a bucket of more than ``BUCKET`` classes is split into blocks, and each pair of its blocks is a task's
group of its own, so no candidate is given up and none is compared in a group without bound.  A group yields a spanning
star of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, Union, batch, bounded, grouped_batches, map_arrow

BANDS, ROWS, BUCKET, SEED = 25, 4, 512, 7
#: Texts are hashed, and sets compared, in slices of so many shingles.
SLICE = 4096
_rng = np.random.default_rng(SEED)
_FACTOR = _rng.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)


def shingles(text: bytes | None, words: int = 5) -> np.ndarray:
    """The distinct shingle hashes (uint64, sorted) of a UTF-8 text; a text with fewer words is one shingle."""
    w = (text or b"").lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    if not w:
        return np.zeros(0, np.uint64)
    grams = [w] if len(w) <= words else zip(*(w[i:] for i in range(words)), strict=False)
    return np.array(sorted({xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams}), np.uint64)


def buckets(hashes: np.ndarray) -> np.ndarray:
    """The ``BANDS`` bucket ids (int64) of a set that is not empty."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(hashes), SLICE):
        np.minimum(least, (hashes[None, i : i + SLICE] * _FACTOR + _SHIFT).min(axis=1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def text_keys() -> list[Column]:
    """h1, h2: equal for equal texts."""
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), F.reverse("text"), F.isnull("text")).alias("h2")]


def similar_pairs(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j, of the sets whose Jaccard similarity is ``least`` or more."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    some = shared[at]
    owner, at = owner[some], number[at[some]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    common = np.zeros((len(sets), len(sets)), np.int64)
    for first in range(0, int(shared.sum()), SLICE):
        lo, hi = np.searchsorted(at, [first, first + SLICE])
        has = np.zeros((len(sets), min(SLICE, int(shared.sum()) - first)), np.float32)
        has[owner[lo:hi], at[lo:hi] - first] = 1
        common += (has @ has.T).astype(np.int64)  # counts up to SLICE are exact
    i, j = np.triu_indices(len(sets), 1)
    both = common[i, j]
    near = (both > 0) & (both / np.maximum(1, sizes[i] + sizes[j] - both) >= least)
    return i[near], j[near]


def links(docs: DataFrame, rows: DataFrame, scratch: Scratch, words: int = 5, least: float = 0.8) -> DataFrame:
    """Edges (a, b) that connect the ``fp`` of all texts of ``docs`` with a similarity of ``least`` or more.

    ``rows`` is a written table of fp, h1, h2 and codes (the buckets) of the rows of ``docs``.
    """
    classes = scratch.keep(rows.where("size(codes) > 0").select("h1", "h2", "fp", "codes").distinct(), "texts")
    members = classes.select("h1", "h2", "fp", F.explode(F.array_distinct("codes")).alias("bucket"))
    marks = [F.bit_xor("h1").alias("m1"), F.bit_xor(F.xxhash64("h1", "h2")).alias("m2")]
    crowded = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.min("fp").alias("lo"), F.max("fp").alias("hi"), *marks).where("lo <> hi")
    crowded = scratch.keep(crowded.groupBy("k", "m1", "m2").agg(F.min("bucket").alias("bucket")).select("bucket", "k"), "crowded")
    places = members.join(bounded(crowded, crowded.count()), "bucket").groupBy("h1", "h2", "fp").agg(F.collect_list(F.struct("bucket", "k")).alias("places"))  # at most one for each band
    places = scratch.keep(places, "places")
    company = bounded(places.select("h1", "h2"), places.count())
    texts = docs.where("text is not null").select(*text_keys(), F.col("text").cast("binary").alias("text")).join(company, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    sets_schema = [("h1", pa.int64()), ("h2", pa.int64()), ("grams", pa.binary())]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                yield batch(sets_schema, h1=part.column(0), h2=part.column(1), grams=[shingles(t.as_py(), words).tobytes() for t in part.column(2)])

    sets = scratch.keep(map_arrow(texts, hashed, "h1 long, h2 long, grams binary"), "sets")
    blocks = F.ceil(F.col("place.k") / F.lit(BUCKET)).cast("int")
    sent = sets.join(places, ["h1", "h2"]).select("h1", "fp", "grams", F.explode("places").alias("place"))
    sent = sent.withColumn("block", F.pmod(F.hash("h1"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    sent = sent.select(F.col("place.bucket").alias("bucket"), F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "fp", "grams")
    dealt = sent.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    schema = [("a", pa.int64()), ("b", pa.int64())]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_batches(batches, ["bucket", "x", "y"]):
            bucket, x, y, fp = (table.column(c).to_numpy() for c in ("bucket", "x", "y", "fp"))
            grams = [np.frombuffer(g.as_py(), np.uint64) for g in table.column("grams")]
            cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            a, b = [], []
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)], strict=True):
                if (fp[s:e] == fp[s]).all():
                    continue
                union = Union(e - s)
                for i, j in zip(*(p.tolist() for p in similar_pairs(grams[s:e], least)), strict=True):
                    union.join(i, j)
                star = [(i, r) for i in range(e - s) if (r := union.find(i)) != i and fp[s + i] != fp[s + r]]
                a += [int(fp[s + i]) for i, _ in star]
                b += [int(fp[s + r]) for _, r in star]
            if a:
                yield batch(schema, a=a, b=b)

    return map_arrow(dealt, search, "a long, b long")
