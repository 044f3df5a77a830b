"""SimHash near-duplicates by a Gray-order hierarchical index.

A fingerprint has a bit set where over half of a text's 3-word shingle hashes (XXH64, seed 42) have it set.  Distinct
fingerprints link at 2 or fewer differing bits; documents take the component of their fingerprint.

The index is a tree of masked bit patterns.  Its upper nodes fix half of the bits: of four 16-bit blocks two at least
are equal in linked fingerprints, so each fingerprint belongs to one upper node for each pair of blocks.  Upper nodes
are spread over the cluster.  One with more than ``NODE`` fingerprints is refined by the same rule on its free bits
(8-bit, then 4-bit blocks), so no task gets more than the 256 fingerprints that eight free bits allow, however large a
group of near copies is; every link survives each refinement.  Within an upper node fingerprints are sorted by Gray
rank and neighbours are factored into lower nodes (a mask of agreeing bits and their values), eight to a node; the
index is joined with itself from the root down, and two groups whose patterns already differ in more than 2 bits are
pruned whole.  A node yields a spanning star of its links, never all pairs.

Defined cases: no words or null text: fingerprint zero, linked like any other; equal rows share a fingerprint; a null
doc_id gets its component but is never its smallest; an empty table gives an empty result; very long texts are hashed
in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import resemblance
from ._common import BROADCAST_ROWS, Scratch, Union, batch, bounded, components, grouped_batches, map_arrow

BITS, WITHIN, FAN, NODE = 64, 2, 8, 1024
SLICE = 100_000


def _bit_counts(hashes: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        grams = [words]
    else:
        grams = list(zip(*(words[i:] for i in range(shingle)), strict=False))
    form = b" ".join([b"%b"] * len(grams[0]))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(grams), SLICE):
        ones += _bit_counts([hashed(form % tuple(g), 42) for g in grams[i : i + SLICE]])
    return int.from_bytes(np.packbits(ones * 2 > len(grams)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""
    schema = [("doc_id", pa.int64()), ("fp", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield batch(schema, doc_id=b.column(0), fp=np.array(values, np.uint64).view(np.int64))

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), run, "doc_id long, fp long")


def sketches(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """doc_id, fp, and for resemblance.links h1, h2 and codes (none without words) of every row."""
    schema = [("doc_id", pa.int64()), ("fp", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("codes", pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(1)]
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            codes = [resemblance.buckets(s) if len(s) else [] for s in (resemblance.shingles(t, words) for t in texts)]
            yield batch(schema, doc_id=b.column(0), fp=fp, h1=b.column(2), h2=b.column(3), codes=codes)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), *resemblance.text_keys())
    return map_arrow(rows, run, "doc_id long, fp long, h1 long, h2 long, codes array<long>")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a code word in the reflected Gray code: neighbours in this order tend to share patterns."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def node_links(fps: np.ndarray) -> np.ndarray:
    """For the distinct uint64 fingerprints of one upper node, the (a, b) of a spanning star of each group of links."""
    fps = fps[np.argsort(gray_rank(fps), kind="stable")]
    n = len(fps)
    levels = [(np.full(n, ~np.uint64(0)), fps)]  # (mask of agreeing bits, their values), leaves first
    while len(levels[-1][0]) > 1:
        mask, value = levels[-1]
        starts = np.arange(0, len(mask), FAN)
        every, some = np.bitwise_and.reduceat(value, starts), np.bitwise_or.reduceat(value, starts)
        agree = np.bitwise_and.reduceat(mask, starts) & ~(every ^ some)
        levels.append((agree, every & agree))
    a = b = np.zeros(1, np.int64)
    for mask, value in reversed(levels[:-1]):
        # children of the pairs that are left; a pair of a node with itself gives each pair of children once
        kids_a = (a[:, None] * FAN + np.arange(FAN)[None, :]).repeat(FAN, axis=1).ravel()
        kids_b = np.tile(b[:, None] * FAN + np.arange(FAN)[None, :], (1, FAN)).ravel()
        there = (kids_a < len(mask)) & (kids_b < len(mask)) & (kids_a <= kids_b)
        a, b = kids_a[there], kids_b[there]
        apart = np.bitwise_count((value[a] ^ value[b]) & mask[a] & mask[b])
        near = apart <= WITHIN
        a, b = a[near], b[near]
    linked = a < b
    if not linked.any():
        return np.zeros((0, 2), np.uint64)
    union = Union(n)
    for x, y in zip(a[linked].tolist(), b[linked].tolist(), strict=True):
        union.join(x, y)
    roots = np.array([union.find(i) for i in range(n)])
    moved = np.flatnonzero(roots != np.arange(n))
    return np.stack([fps[moved], fps[roots[moved]]], axis=1)


def _masks(fixed: int, width: int) -> list[int]:
    """Masks that fix two of the four blocks of the bits that ``fixed`` leaves free."""
    free = [i for i in range(BITS) if not fixed >> i & 1]
    blocks = [sum(1 << i for i in free[j * width : (j + 1) * width]) for j in range(4)]
    return [fixed | x | y for x, y in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) that connect all distinct ``fp`` within 2 bits of each other, directly or through others."""
    schema = [("a", pa.int64()), ("b", pa.int64())]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_batches(batches, ["mask", "key"]):
            mask, key = table.column("mask").to_numpy(), table.column("key").to_numpy()
            fp = table.column("fp").to_numpy().view(np.uint64)
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fp)]])
            several = ends - starts > 1
            found = [node_links(fp[s:e]) for s, e in zip(starts[several].tolist(), ends[several].tolist(), strict=True)]
            if found:
                out = np.concatenate(found).view(np.int64)
                yield batch(schema, a=out[:, 0], b=out[:, 1])

    def nodes(df: DataFrame, masks: list[int]) -> DataFrame:
        m = F.explode(F.array(*[F.lit(_signed(x)) for x in masks]))
        return df.select("fp", m.alias("mask")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))

    found = None
    at = nodes(fps, _masks(0, 16))
    for level, width in enumerate((8, 4, 0)):
        large = None
        if width:
            sizes = at.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > NODE).drop("n")
            large = scratch.keep(sizes, f"large-{level}")
            n_large = large.count()
            large = F.broadcast(large) if n_large <= BROADCAST_ROWS else large
        rest = at.join(large, ["mask", "key"], "left_anti") if large is not None and n_large else at
        dealt = rest.repartition("mask", "key").sortWithinPartitions("mask", "key").select("mask", "key", "fp")
        some = map_arrow(dealt, search, "a long, b long")
        found = some if found is None else found.unionByName(some)
        if large is None or not n_large:
            break
        # an upper node that is too large is refined: its 6 sub-nodes fix two of four blocks of the bits that are free
        crowded = at.join(large, ["mask", "key"], "left_semi").select("fp", "mask")
        # masks of different parents can coincide
        parents = dict.fromkeys(m for fixed in ([0] if level == 0 else _masks(0, 16)) for m in _masks(fixed, 16 if level == 0 else 8))
        deeper = F.create_map(*[x for p in parents for x in (F.lit(_signed(p)), F.array(*[F.lit(_signed(c)) for c in _masks(p, width)]))])
        at = crowded.select("fp", F.explode(F.element_at(deeper, F.col("mask"))).alias("mask")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        at = scratch.keep(at.distinct(), f"nodes-{level + 1}")
    return found


def _rooted(docs: DataFrame, scratch: Scratch, shingle: int, similarity: float | None, words: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp; with a similarity h1, h2 too), and for each fp its least doc_id and its component's root."""
    rows = scratch.keep(fingerprints(docs, shingle) if similarity is None else sketches(docs, shingle, words), "fingerprints")
    n = rows.count()  # no slim table of classes or rows below has more
    classes = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes", n)
    found = links(classes.select("fp"), scratch)
    if similarity is not None:
        found = found.unionByName(resemblance.links(docs, rows, scratch, words, similarity))
    roots = components(found, scratch)
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return rows, scratch.keep(rooted, "rooted", n)


def near_duplicates(docs: DataFrame, shingle: int = 3, similarity: float | None = None, words: int = 5) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of the component) of every row.

    With a ``similarity`` texts link also if the Jaccard similarity of their sets of shingles of ``words`` reaches it.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows, rooted = _rooted(docs, scratch, shingle, similarity, words)
    # components of several fingerprints only; all others are their own
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.keep(rooted.join(least, "root").select("fp", "component_id"), "named")
    return rows.select("doc_id", "fp").join(named, "fp")


def one_of_each(docs: DataFrame, shingle: int = 3, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """One row of ``docs`` for each component (see near_duplicates): that of the smallest doc_id.

    Rows are told apart by doc_id and text.  So a doc_id may be null (it stays only if its component has no other) or
    stand for different texts, each of which has its own component; of wholly equal rows one stays.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    rows, rooted = _rooted(docs, scratch, shingle, similarity, words)
    n = rows.count()
    key = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "h1", "h2")
    found = rows.select("fp", key.alias("row")).join(rooted.select("fp", "root"), "fp")
    groups = scratch.keep(found.groupBy("root").agg(F.min("row").alias("stays"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "groups", n)
    # only rows of groups are looked at again, and the rows that go are fewer than those that stay
    told = found.join(groups, "root").groupBy("row").agg(F.first(F.col("row") == F.col("stays")).alias("own"), F.count(F.lit(1)).alias("n"))
    told = scratch.keep(told.where("not own or n > 1").select("row.doc_id", "row.h1", "row.h2", "own"), "told", n)
    n_gone, n_again = told.agg(F.count_if(~F.col("own")), F.count_if(F.col("own"))).first()
    text = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_id"), *resemblance.text_keys())  # a struct, so that no name can clash
    same = lambda t: F.col("_id").eqNullSafe(t["doc_id"]) & (F.col("_h1") == t["h1"]) & (F.col("_h2") == t["h2"])
    out = text.withColumnsRenamed({"h1": "_h1", "h2": "_h2"})
    gone, again = bounded(told.where("not own"), n_gone), bounded(told.where("own"), n_again)
    out = out.join(gone, same(gone), "left_anti")
    if n_again:
        out = out.join(again, same(again), "left_anti").unionByName(out.join(again, same(again), "left_semi").dropDuplicates(["_id", "_h1", "_h2"]))
    return out.select("_row.*")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
