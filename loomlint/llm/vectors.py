"""Embedding near-duplicates by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; the axis (and its sign) nearest to
the rotated vector is its hash.  A table's bucket is a few such hashes; each vector also probes the buckets in which one
hash is replaced by its second-nearest axis.  Vectors that share a bucket in any table are candidates, and every
candidate pair is verified by its cosine in double precision.  The number of hashes follows the number of vectors, so
that a table has some twenty buckets for each and unrelated vectors seldom meet; more hashes come with more tables
(``TABLES``), which keeps the recall.

Equal vectors are one class, so copies are never compared with each other.  Of buckets with the same members one is
looked into, and vectors travel to those only.  A pair is counted only in the least of them that it shares, so link
counts need no list of pairs; each bucket gives counts per vector and a spanning star of its links.  A bucket of more than ``BUCKET`` classes is split into blocks, and each pair of its blocks is a task's
group of its own, so no candidate is given up and none is compared in a group without bound.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths never link; a row without vec_id links by its class, and is not considered for component_id, which is
null where no row of a component has one; rows that share a vec_id link each by its own vector; an empty table gives an
empty result.  Recall is measured by the tests (at cosine 0.9 above 0.99 for 64 components).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, Union, batch, components, grouped_batches, map_arrow

#: Tables for each number of hashes: recall at cosine 0.9 stays above 0.997 for 64 components (measured by the tests).
TABLES = {2: 8, 3: 12, 4: 20, 5: 32}
BUCKET, SEED = 1024, 11


def plan(vectors: int, dim: int) -> tuple[int, int]:
    """(tables, hashes) for a number of vectors: the fewest hashes whose buckets outnumber them twenty times.

    Near vectors share their nearest axis less often among more axes, so wider vectors take more tables.
    """
    width = max(2, 1 << (dim - 1).bit_length())
    hashes = next((k for k in TABLES if (2 * width) ** k >= 20 * vectors), max(TABLES))
    return math.ceil(TABLES[hashes] * (1 + max(0, math.log2(width / 64)) / 2)), hashes


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each column, in place; the height is a power of two."""
    width, n = x.shape
    step = 1
    while step < width:
        y = x.reshape(width // (2 * step), 2, step, n)
        total = y[:, 0] + y[:, 1]
        np.subtract(y[:, 0], y[:, 1], out=y[:, 1])
        y[:, 0] = total
        step *= 2
    x /= np.sqrt(width)
    return x


def buckets(x: np.ndarray, tables: int, hashes: int, seed: int = SEED) -> np.ndarray:
    """Bucket ids (int64) of each row, table by table: its own and its probed ones."""
    n, dim = x.shape
    width = max(2, 1 << (dim - 1).bit_length())
    columns = np.zeros((width, n))  # a vector is a column, so every step of the transform runs along memory
    columns[:dim] = x.T
    rng = np.random.default_rng([seed, width])
    every, out = np.arange(n), []
    for table in range(tables):
        codes = []
        for _ in range(hashes):
            y = columns
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], (width, 1)))
            size = np.abs(y)
            first = size.argmax(axis=0)
            size[first, every] = -1
            second = size.argmax(axis=0)
            codes.append([2 * axis + (y[axis, every] < 0) for axis in (first, second)])
        own = [c[0] for c in codes]
        probes = [own] + [[*own[:h], codes[h][1], *own[h + 1 :]] for h in range(hashes)]
        for probe in probes:
            key = np.full(n, (table + 1) * 1_000_003 + dim, np.uint64)
            for c in probe:
                key = (key ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(31)
            out.append(key.view(np.int64))
    return np.stack(out, axis=1)


def usable(vector: str) -> Column:
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda v: v != 0), F.lit(False))


SMALL = 16  # groups up to this size are compared together


def near_pairs(u: np.ndarray, starts: np.ndarray, ends: np.ndarray, bucket: np.ndarray, least: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of unit rows at ``cosine`` or more within the groups starts[k]:ends[k] of bucket[k].

    Rows whose least buckets are one and less than the group's meet there already and are not compared again; a group of
    near copies costs its pairs once, not once for each bucket that it fills.
    """
    found = [np.zeros((2, 0), np.int64)]
    sizes = ends - starts
    for m in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]).tolist():
        p, q = np.triu_indices(m, 1)
        i, j = ((starts[sizes == m][:, None] + x).ravel() for x in (p, q))
        own = np.repeat(bucket[sizes == m], len(p))
        new = (least[i] != least[j]) | (least[i] == own)
        i, j = i[new], j[new]
        for s in range(0, len(i), 100_000):
            a, b = i[s : s + 100_000], j[s : s + 100_000]
            near = np.einsum("ij,ij->i", u[a], u[b]) >= cosine
            found.append(np.stack([a[near], b[near]]))
    for k in np.flatnonzero(sizes > SMALL).tolist():
        rows = np.arange(starts[k], ends[k])
        rows = rows[np.argsort(least[rows], kind="stable")]
        first = np.flatnonzero(np.append(True, least[rows][1:] != least[rows][:-1]))
        last = np.append(first[1:], len(rows))
        for lo, hi in zip(first.tolist(), last.tolist(), strict=True):
            # one class of rows against those of later classes, and with itself if they first meet here
            rest = rows[lo:] if least[rows[lo]] == bucket[k] else rows[hi:]
            for s in range(lo, hi, 512) if len(rest) else ():
                i, j = np.nonzero(u[rows[s : min(hi, s + 512)]] @ u[rest].T >= cosine)
                i, j = rows[i + s], rest[j]
                once = (least[i] != least[j]) | (i < j)
                i, j = i[once], j[once]
                found.append(np.stack([np.minimum(i, j), np.maximum(i, j)]))
    i, j = np.concatenate(found, axis=1)
    return i, j


def met_before(codes: np.ndarray, i: np.ndarray, j: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Whether rows i and j share a bucket that is less than theirs; ``codes`` are by row, table and probe."""
    out = np.zeros(len(i), bool)
    for s in range(0, len(i), 50_000):
        a, b, own = codes[i[s : s + 50_000]], codes[j[s : s + 50_000]], bucket[s : s + 50_000, None]
        for p in range(codes.shape[2]):
            mine = a[:, :, p]
            lower = (mine < own) & (mine != 0)  # 0 stands for buckets that are not looked into
            for q in range(codes.shape[2]):
                out[s : s + 50_000] |= ((mine == b[:, :, q]) & lower).any(axis=1)
    return out


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, tables: int | None = None, hashes: int | None = None, bucket_size: int = BUCKET) -> DataFrame:
    """``vectors`` (vec_id, embedding) to vec_id, n_links, component_id, kept; tables and hashes by ``plan`` if not given."""
    scratch = Scratch(vectors.sparkSession, "vectors")
    double = "array<double>" in vectors.schema["embedding"].dataType.simpleString()
    kind = np.float64 if double else np.float32
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").withColumn("ok", usable("embedding"))
    keys = [F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2")]
    classes = rows.where("ok").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    if tables is None:
        if hashes is not None:
            raise ValueError("hashes need a number of tables")
        n, dim = rows.where("ok").agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
        tables, hashes = plan(n, dim or 1)
    elif hashes is None:
        raise ValueError("tables need a number of hashes")
    coded_schema = [("least", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int32()), ("vec", pa.binary()), ("codes", pa.list_(pa.int64()))]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("embedding")
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
            starts = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                x = flat[starts[at][:, None] + np.arange(dim)]
                ids = buckets(x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True), tables, hashes)
                col = {c: b.column(c).take(pa.array(at)) for c in ("least", "n", "h1", "h2")}
                yield batch(coded_schema, **col, vec=[v.tobytes() for v in x], codes=list(ids))

    coded = map_arrow(classes.select("least", "n", *keys, "embedding"), code, "least long, n long, h1 long, h2 int, vec binary, codes array<long>")
    coded = scratch.keep(coded.withColumn("cls", F.monotonically_increasing_id()), "coded")  # a class has a number of its own, as written
    # ids alone find the buckets with company; of buckets with the same members one is enough; vectors travel to those only
    members = coded.select("cls", F.explode(F.array_distinct("codes")).alias("bucket"))
    marks = [F.bit_xor(F.xxhash64("cls")).alias("m1"), F.bit_xor(F.xxhash64(F.lit("second"), "cls")).alias("m2")]
    crowded = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), *marks).where("k > 1 and bucket <> 0")
    crowded = scratch.keep(crowded.groupBy("k", "m1", "m2").agg(F.min("bucket").alias("bucket")).select("bucket", "k"), "crowded")
    places = members.join(crowded, "bucket").groupBy("cls").agg(F.collect_list(F.struct("bucket", "k")).alias("places"))  # at most one for each code
    there = coded.join(places, "cls").withColumn("codes", F.transform("codes", lambda c: F.when(F.array_contains("places.bucket", c), c).otherwise(F.lit(0))))
    blocks = F.ceil(F.col("place.k") / F.lit(bucket_size)).cast("int")
    sent = there.select("cls", "n", "vec", "codes", F.explode("places").alias("place"))
    sent = sent.withColumn("block", F.pmod(F.hash("cls"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    sent = sent.select(F.col("place.bucket").alias("bucket"), F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "cls", "n", "vec", "codes")
    dealt = sent.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    schema = [("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_batches(batches, ["bucket", "x", "y"]):
            table = table.combine_chunks()
            bucket, x, y, block, cls, n = (table.column(c).to_numpy() for c in ("bucket", "x", "y", "block", "cls", "n"))
            vec, lists = table.column("vec").chunk(0), table.column("codes").chunk(0)
            codes = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(cls), tables, -1)
            new = (bucket[1:] != bucket[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            starts = np.concatenate([[0], np.flatnonzero(new) + 1])
            ends = np.append(starts[1:], len(cls))
            flat = np.frombuffer(b"".join(vec.to_pylist()), kind).astype(np.float64)
            sizes = pc.binary_length(vec).to_numpy() // np.dtype(kind).itemsize
            at = np.cumsum(sizes) - sizes
            least = np.where(codes == 0, np.iinfo(np.int64).max, codes).min(axis=(1, 2))
            pairs = []
            for dim in np.unique(sizes).tolist():  # vectors of one bucket are of one length
                groups = sizes[starts] == dim
                rows = np.flatnonzero(sizes == dim)
                u = flat[at[rows][:, None] + np.arange(dim)]
                u /= np.linalg.norm(u, axis=1, keepdims=True)
                i, j = near_pairs(u, np.searchsorted(rows, starts[groups]), np.searchsorted(rows, ends[groups]), bucket[starts[groups]], least[rows], cosine)
                pairs.append((rows[i], rows[j]))
            i, j = (np.concatenate(p) for p in zip(*pairs, strict=True))
            # a group of two blocks is for the pairs between them
            right = (x[i] == y[i]) | (block[i] != block[j])
            i, j = i[right], j[right]
            keep = ~met_before(codes, i, j, bucket[i])
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            add = np.bincount(i, n[j], len(cls)) + np.bincount(j, n[i], len(cls))
            some = np.flatnonzero(add)
            union = Union(len(cls))
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                union.join(p, q)
            star = [(p, r) for p in some.tolist() if (r := union.find(p)) != p]
            a = np.concatenate([cls[some], cls[[p for p, _ in star]]]) if star else cls[some]
            b = [None] * len(some) + [int(cls[r]) for _, r in star]
            yield batch(schema, a=a, b=b, links=[*add[some].astype(np.int64).tolist(), *[0] * len(star)])

    found = scratch.keep(map_arrow(dealt, search, "a long, b long, links long"), "found")
    scratch.drop("crowded")
    roots = components(found.where("b is not null").select("a", "b"), scratch)
    counts = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    rooted = coded.select("cls", "least", "n", "h1", "h2").join(counts, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    rooted = scratch.keep(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    result = rooted.join(smallest, "root").select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    result = scratch.keep(result, "result")
    fine = rows.where("ok").select("vec_id", *keys).join(result, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return fine.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.9 and components of all embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x for x in embedding if x <> 0]) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
), roots AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM link WHERE link.a = e.vec_id) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN roots r USING (vec_id)
"""
