"""A quality classifier from positive and unlabelled texts.

A linear model over features of the whole text minimises the non-negative unbiased risk: with class prior p, logistic
loss l, trusted positives P and unlabelled texts U, the risk is  p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)]).
Where the second term is not negative, the risk is convex and smooth: Newton steps go down it, and a step is cut short
where it would make that term negative, which keeps the model from fitting the unlabelled texts as negatives.  The prior
is the share of label 1 among the training labels.

All training texts are U and all training texts with label 1 are P, at any size: the risk, its gradient and its
curvature are sums over a written table of features, added up on the cluster, and the driver sees as many numbers as
there are pairs of features.  A fit takes ``STEPS`` steps at most, of two such sums each.  Only the text is an input of a
score.

Defined cases: null and empty texts have features (all counts zero) and so a score; without any positive all scores
are 0.5; a null doc_id is an unlabelled training text; repeated rows, also of one doc_id, are texts of their own; a
doc_id with labels 0 and 1 is a positive; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, batch, bounded, map_arrow

STEPS, RIDGE = 6, 0.01
#: Parts of a step that are tried, the whole one first.
PARTS = [2.0**-i for i in range(6)]
#: Bytes whose share of the text is a feature of its own.
MARKS = [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]
_UPPER, _LOWER, _DIGIT = slice(0x41, 0x5B), slice(0x61, 0x7B), slice(0x30, 0x3A)
N_FEATURES = 2 * len(MARKS) + 20


def features(text: bytes | None) -> np.ndarray:
    """Shares of byte classes and marks, repetition among words and lines, lengths; each in about 0 to 1."""
    data = text or b""
    n = max(1, len(data))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    m = max(1, len(words))
    seen = Counter(words)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / m
    caps = sum(w.isupper() and len(w) > 1 for w in words) / m
    marked = sum(not w[-1:].isalnum() and w[-1] < 0x80 and w[-1:] not in b".,;:?!" for w in words) / m
    lone = sum(len(w) == 1 and not w.isalnum() for w in words) / m
    lines = [x for x in data.split(b"\n") if x.strip()]
    again = 1 - len(set(lines)) / max(1, len(lines))
    pairs = Counter(zip(words, words[1:], strict=False))
    dense = [
        counts[_UPPER].sum() / n, counts[_LOWER].sum() / n, counts[_DIGIT].sum() / n, counts[0x80:].sum() / n, counts[0x0A] / n,
        1 - len(seen) / m, max(seen.values(), default=0) / m, same, np.sqrt(same), caps, np.sqrt(caps), marked, np.sqrt(marked), lone, np.sqrt(lone), again,
        max(pairs.values(), default=0) / m, min(1.0, np.log1p(len(words)) / 12), min(1.0, (n / m) / 20), 1.0 if not words else 0.0,
    ]
    marks = counts[MARKS] / n
    return np.concatenate([dense, marks, np.sqrt(marks)]).astype(np.float32)


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.scale @ self.weights + self.bias, -40, 40)))


class Sums:
    """What a fit adds up over rows (positive or not, features): ``add`` a part's rows, with weights of a model.

    ``moments`` of positives and all texts; ``curve``: gradient and curvature of the softplus of all texts at weights;
    ``risks``: its sums over all texts and over positives at several weights.
    """

    @staticmethod
    def moments(x: np.ndarray, pos: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x), pos.sum()], x.sum(axis=0), (x * x).sum(axis=0), x[pos].sum(axis=0)])

    @staticmethod
    def curve(z: np.ndarray, w: np.ndarray) -> np.ndarray:
        s = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        return np.concatenate([s @ z, ((z * (s * (1 - s))[:, None]).T @ z)[np.triu_indices(z.shape[1])]])

    @staticmethod
    def risks(z: np.ndarray, pos: np.ndarray, weights: np.ndarray) -> np.ndarray:
        high = np.logaddexp(0, z @ weights.T)
        return np.concatenate([high.sum(axis=0), high[pos].sum(axis=0)])


def fit(total, width: int, prior: float, ridge: float = RIDGE, steps: int = STEPS) -> Model:
    """Minimise the non-negative risk; ``total(f)`` is the sum of f(x, pos) over all parts of the table.

    The ridge is ``ridge`` and as much as there are features for each text, which matters for small tables only.
    """
    none = Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    first = total(Sums.moments)
    n, n_pos = first[:2]
    if not n or not n_pos:
        return none
    mean, square, good = first[2:].reshape(3, width) / np.array([[n], [n], [n_pos]])
    scale = np.sqrt(np.maximum(0, square - mean * mean)) + 1e-4
    good = np.append((good - mean) / scale, 1.0)  # the mean positive
    unit = lambda x: np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    ridge = ridge + (width + 1) / n
    w, now = np.zeros(width + 1), np.log(2)
    for _ in range(steps):
        at = w
        sums = total(lambda x, pos: Sums.curve(unit(x), at)) / n  # noqa: B023
        slope = sums[: width + 1] - prior * good + ridge * w
        curve = np.zeros((width + 1, width + 1))
        curve[np.triu_indices(width + 1)] = sums[width + 1 :]
        curve = curve + np.triu(curve, 1).T + ridge * np.eye(width + 1)
        step = np.linalg.solve(curve, slope)
        tried = np.array([w - t * step for t in PARTS])
        found = total(lambda x, pos: Sums.risks(unit(x), pos, tried))  # noqa: B023
        high, high_pos = found[: len(PARTS)] / n, found[len(PARTS) :] / n_pos
        # l(f) - l(-f) = -f, so this is the whole risk where the second term is not negative
        risk = high - prior * tried @ good + ridge * (tried * tried).sum(axis=1) / 2
        fine = np.flatnonzero((high - prior * high_pos >= 0) & (risk < now - 1e-6))
        if not len(fine):
            break
        w, now = tried[fine[0]], risk[fine[0]]
    w = np.round(w, 9)  # sums of parts differ in their last digits from run to run
    return Model(mean, scale, w[:-1], float(w[-1]))


def total_over(x: np.ndarray, pos: np.ndarray):
    """``total`` of ``fit`` for rows in memory."""
    return lambda f: f(x, pos)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def featured(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, x (features, float32), train, pos of every row, written."""
    schema = [("doc_id", pa.int64()), ("x", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(schema, doc_id=b.column(0), x=[features(t.as_py()).tobytes() for t in b.column(1)])

    known = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).where(~held_out()).distinct()
    known = scratch.keep(known.withColumn("pos", F.lit(True)), "positives")
    rows = map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), run, "doc_id long, x binary")
    rows = rows.join(bounded(known, known.count()), "doc_id", "left")
    return scratch.keep(rows.select("doc_id", "x", (~held_out()).alias("train"), F.coalesce("pos", F.lit(False)).alias("pos")), "features")


def trained(rows: DataFrame, labels: DataFrame, ridge: float = RIDGE, steps: int = STEPS) -> Model:
    """Fit on the rows of ``featured`` that are for training: the folds whose crc32(doc_id) mod 3 is not 1."""
    prior = labels.where(F.col("doc_id").isNotNull() & ~held_out()).agg(F.avg(F.col("quality").cast("double"))).first()[0]
    table = rows.where("train").select("x", "pos")

    def total(f) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = 0.0
            for b in batches:
                if b.num_rows:
                    x = np.frombuffer(b"".join(b.column(0).to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)
                    sums = sums + f(x, b.column(1).to_numpy(zero_copy_only=False))
            if np.ndim(sums):
                yield batch([("i", pa.int32()), ("v", pa.float64())], i=np.arange(len(sums)), v=sums)

        got = map_arrow(table, run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # as many as pairs of features
        return np.array([r.v for r in got]) if got else np.zeros(2 + 3 * N_FEATURES)

    return fit(total, N_FEATURES, prior or 0.5, ridge, steps)


def train(docs: DataFrame, labels: DataFrame, ridge: float = RIDGE, steps: int = STEPS) -> Model:
    """A model of all training texts of ``docs``."""
    scratch = Scratch(docs.sparkSession, "quality")
    return trained(featured(docs, labels, scratch), labels, ridge, steps)


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of ``featured``."""
    schema = [("doc_id", pa.int64()), ("score", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)
            yield batch(schema, doc_id=b.column(0), score=model.score(x))

    return map_arrow(rows.select("doc_id", "x"), run, "doc_id long, score double")


def kept_documents(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, whole, whose text scores ``threshold`` or more."""

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        x = np.array([features(t) for t in text], np.float64).reshape(-1, N_FEATURES)
        return pd.Series(model.score(x))

    return docs.where(score(F.col("text").cast("binary")) >= threshold)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from the training folds of `labels`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    rows = featured(docs, labels, Scratch(spark, "quality"))
    out = scored(rows, trained(rows, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
