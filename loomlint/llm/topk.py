"""Exact top-k search by inner product over norm-sorted vectors.

Candidates are sorted by descending length and packed into blocks; all vectors are rotated by the eigenvectors of the
Gram matrix of all candidates (the right singular vectors), so the first rotated components carry most of a product.
The k-th best score of a query among the longest candidates bounds it from below.  A block whose longest vector cannot
reach any query's bound is never joined with it (Cauchy-Schwarz), and within a block partial sums over the first
rotated components plus the product of the residual lengths prune candidates step by step.  What is left is scored in
integers, so the result is exact: bounds only decide what need not be scored, with a margin for rounding.

Queries and candidates meet in blocks: each pair of blocks that is not pruned is one row of work, whatever the size of
the table, and a query gives at most k rows per block.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows without vec_id;
wholly equal rows count once; missing trailing components of shorter vectors are zero; fewer than k candidates give as
many rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, batch, map_arrow, partitions

BLOCK, QUERY_BLOCK = 4096, 512


def usable(vector: str) -> Column:
    return F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def _pack(rows: list[list[int]], dim: int) -> np.ndarray:
    if all(len(r) == dim for r in rows):
        return np.array(rows, np.int64).reshape(len(rows), dim)
    out = np.zeros((len(rows), dim), np.int64)
    for x, r in zip(out, rows, strict=True):
        x[: len(r)] = r
    return out


def packed(vectors: DataFrame, dim: int, size: int, rows: int) -> DataFrame:
    """Rows (id, q, norm) in blocks by descending norm: block, top (greatest norm), ids, data (binary int64)."""
    schema = [("block", pa.int64()), ("top", pa.float64()), ("ids", pa.binary()), ("data", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> pa.RecordBatch:
            ids = table.column("id").to_numpy()
            top = float(table.column("norm")[0].as_py())
            data = _pack(table.column("q").to_pylist(), dim)
            return batch(schema, block=[int(ids[0])], top=[top], ids=[ids.tobytes()], data=[data.tobytes()])

        n = 0
        for b in batches:
            while b.num_rows:
                take = b.slice(0, size - n)
                held.append(take)
                n, b = n + take.num_rows, b.slice(take.num_rows)
                if n == size:
                    yield flush(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield flush(pa.Table.from_batches(held))

    wide = max(1, -(-rows // size))
    sorted_ = vectors.repartitionByRange(wide, F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id")
    return map_arrow(sorted_.select("id", "q", "norm"), run, "block long, top double, ids binary, data binary")


def best_of(qi: np.ndarray, q: np.ndarray, floor: np.ndarray, ci: np.ndarray, c: np.ndarray, rotation: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of up to k best candidates per query that may reach its floor."""
    dim = q.shape[1]
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    lengths = np.sqrt((qf * qf).sum(1)), np.sqrt((cf * cf).sum(1))
    margin = 1e-9 * (1 + lengths[0].max() * lengths[1].max())
    # candidates are in order of length: those beyond every query's reach are a tail
    reach = np.where(lengths[0] > 0, (floor - margin) / np.maximum(lengths[0], 1e-300), np.where(floor > 0, np.inf, -np.inf)).min()
    far = int(np.searchsorted(-lengths[1], -reach, side="right")) if np.isfinite(reach) else (len(c) if reach < 0 else 0)
    left = np.arange(far)
    if np.isfinite(floor).any() and far:
        qr, cr = qf @ rotation, cf[:far] @ rotation
        q2, c2 = (qr * qr).cumsum(1), (cr * cr).cumsum(1)
        for step in sorted({dim // 8, dim // 4, dim // 2} - {0}):
            rest = np.sqrt(np.maximum(0, q2[:, -1] - q2[:, step - 1]))[:, None] * np.sqrt(np.maximum(0, c2[left, -1] - c2[left, step - 1]))[None]
            could = qr[:, :step] @ cr[left, :step].T + rest >= floor[:, None] - margin
            left = left[could.any(axis=0)]
    if not len(left):
        return tuple(np.zeros((3, 0), np.int64))
    if lengths[0].max() * lengths[1].max() < 2**52:
        scores = (qf @ cf[left].T).astype(np.int64)  # sums of integers below 2^53 are exact
    else:
        scores = q @ c[left].T
    ids = ci[left]
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1) if scores.shape[1] <= 4 * k else None
    if order is None:
        kth = -np.partition(-scores, k, axis=1)[:, k]  # one more than k, for the query's own row
        rows, cols = np.nonzero(scores >= kth[:, None])
    else:
        rows, cols = np.repeat(np.arange(len(q)), scores.shape[1]), order.ravel()
    keep = (qi[rows] != ids[cols]) & (scores[rows, cols] >= floor[rows])
    rows, cols = rows[keep], cols[keep]
    value, cand = scores[rows, cols], ids[cols]
    by = np.lexsort((cand, -value, rows))
    rows, value, cand = rows[by], value[by], cand[by]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    best = place < k
    return qi[rows[best]], cand[best], value[best]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``vectors`` (vec_id, embedding) to query_id, rank, vec_id, score over the vectors in integers floor(scale * x)."""
    scratch = Scratch(vectors.sparkSession, "topk")
    spark = vectors.sparkSession
    usual = vectors.where(F.col("vec_id").isNotNull() & usable("embedding"))
    whole = usual.select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("q"), is_query.alias("asks"))
    whole = whole.withColumn("norm", F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))
    whole = scratch.keep(whole.distinct(), "integers")
    rows, asked, dim = whole.agg(F.count(F.lit(1)), F.count_if(F.coalesce("asks", F.lit(False))), F.max(F.size("q"))).first()
    empty = spark.range(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    if not asked or not dim:
        return empty

    gram_schema = [("i", pa.int32()), ("row", pa.list_(pa.float64()))]

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((dim, dim))
        for b in batches:
            x = _pack(b.column(0).to_pylist(), dim).astype(np.float64)
            g += x.T @ x
        yield batch(gram_schema, i=range(dim), row=list(g))

    sums = map_arrow(whole.select("q"), gram, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    g = np.zeros((dim, dim))
    for i, j, v in sums.groupBy("i", "j").agg(F.sum("v")).collect():  # dim x dim numbers
        g[i, j] = v
    rotation = np.linalg.eigh(g)[1][:, ::-1].copy()

    candidates = scratch.keep(packed(whole, dim, block, rows), "candidates")
    asking = packed(whole.where("asks"), dim, query_block, asked)
    _, _, seed_ids, seed_data = candidates.orderBy(F.desc("top"), "block").first()  # one block
    query_schema = [("q_block", pa.int64()), ("reach", pa.float64()), ("q_ids", pa.binary()), ("q_data", pa.binary()), ("floors", pa.binary())]

    def ints(x: bytes) -> np.ndarray:
        return np.frombuffer(x, np.int64)

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ci, c = ints(seed_ids), ints(seed_data).reshape(-1, dim)
        for b in batches:
            for name, ids, data in zip(b.column("block").to_pylist(), b.column("ids").to_pylist(), b.column("data").to_pylist(), strict=True):
                qi, q = ints(ids), ints(data).reshape(-1, dim)
                asker, _, score = best_of(qi, q, np.full(len(qi), -np.inf), ci, c, rotation, k)
                floors = np.full(len(qi), -np.inf)
                at = {x: n for n, x in enumerate(qi.tolist())}
                full, counts = np.unique(asker, return_counts=True)
                for x in full[counts == k].tolist():
                    floors[at[x]] = score[asker == x].min()
                norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
                reach = np.where(norm > 0, floors / np.maximum(norm, 1e-300), np.where(floors > 0, np.inf, -np.inf)).min()
                yield batch(query_schema, q_block=[name], reach=[float(reach)], q_ids=[ids], q_data=[data], floors=[floors.tobytes()])

    queries = scratch.keep(map_arrow(asking, seed, "q_block long, reach double, q_ids binary, q_data binary, floors binary"), "queries")
    # the stated queries meet all rows in blocks; lanes spread the pairs of blocks over the cluster
    lanes = max(1, min(-(-rows // block), 4 * partitions(spark)))
    laned = candidates.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)))
    asks = queries.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    # queries are a share of all rows, and every lane has them all: they are dealt to the lanes, never broadcast
    pairs = laned.join(asks.hint("merge"), "lane").where(F.col("top") * (1 + 1e-9) >= F.col("reach"))
    schema = [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                qi, q, floors, ci, c = (b.column(x)[i].as_py() for x in ("q_ids", "q_data", "floors", "ids", "data"))
                found = best_of(ints(qi), ints(q).reshape(-1, dim), np.frombuffer(floors, np.float64), ints(ci), ints(c).reshape(-1, dim), rotation, k)
                yield batch(schema, query_id=found[0], vec_id=found[1], score=found[2])

    some = map_arrow(pairs.select("q_ids", "q_data", "floors", "ids", "data"), score, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return some.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all embeddings for each vector whose id is divisible by 50."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(x * 256) AS BIGINT) for x in CAST(embedding AS DOUBLE[])] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([p[1] * p[2] for p in list_zip(a.q, b.q)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
