"""Language-model scores by a weighted backoff automaton.

The model: a state for every context seen in training, an arc for every n-gram that continues it, and a failure arc to
the state of the next shorter context; the root holds every word and one class for unknown words.  With m the weight
of the order, c the training counts and h' the context without its first token,
    p(w | h) = (c(h w) + m p(w | h')) / (c(h) + m),      root: p(w) = (c(w) - d) / N, unknown words d V / N,
with d = n1 / (n1 + 2 max(n2, 1)) from the numbers of words seen once and twice, which is below 1.  So the arc of a seen
n-gram bears its probability and the failure arc of h bears m / (c(h) + m); each state's probabilities sum to 1.  A text
is read once from left to right, from the state of a text's end, carrying the state and adding log10 of the arcs that it
takes.

Neither counts nor automaton are ever in one place: documents are dealt to blocks; a block sends its distinct n-grams
and their own training counts, packed and sorted, to the buckets of a hash; a bucket sums them and answers each block
with the totals that differ from what the block knows.  A block then builds the states, arcs and failure arcs that its
texts can take, and traverses them.  All n-grams of all training documents are counted; there is no cutoff.

Rows exchanged: each order costs blocks x min(buckets, distinct n-grams of a block) requests and at most as many
answers; blocks and buckets follow the bytes of text.  A request holds all n-grams that a block has for a bucket, so the
bytes follow the text, and the rows are at most one for each distinct n-gram of a block.

N-grams are told apart by 64-bit hashes.  Defined cases: a null or empty text is one end token; a null doc_id is a
training document; repeated rows are counted and scored each (more than ``COPIES`` equal ones are read once, with their
number); without training tokens every score is 0; an empty table gives an empty result; a word of any length is one
token.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, bounded, enumerated, partitions

#: Weight of the shorter context, for n-grams of two tokens, three and so on; the query's order is their number plus 1.
BACKOFF = (500.0,)
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 10 << 20  # of text for each block, and for each bucket
#: More equal rows than this are dealt to their block as one row with a number.
COPIES = 1000
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
END = xxhash.xxh64_intdigest(b"\n")  # no word holds a line feed


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def tokens(texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts (words, A-Z lowered, and an end for each), and each text's first place."""
    known, parts, sizes = _Words(), [], []
    for text in texts:
        words = (text or b"").lower().split()
        part = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        parts.append(part)
        parts.append(np.array([END], np.uint64))
        sizes.append(len(words) + 1)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.cumsum(sizes) - sizes


def ngrams(token: np.ndarray, first: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1..order: hashes of the n-grams that end at each token, and where a text has so many tokens.

    A text is preceded by an end, whose state it starts from.
    """
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[first] = END
    place = np.arange(len(token)) - np.repeat(first, np.diff(np.append(first, len(token))))
    out = [(token, np.ones(len(token), bool))]
    for n in range(2, order + 1):
        shorter = out[-1][0]
        previous = np.empty_like(token)
        previous[1:] = shorter[:-1]
        previous[first] = END  # only pairs reach before a text's first token; the rest is a fixed value out of use
        if n == 2:
            previous = before
        mixed = (previous * _MULTIPLY) ^ (previous >> np.uint64(29)) ^ np.uint64(n)
        mixed = (mixed + token) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((mixed ^ mixed >> np.uint64(32), place + 2 >= n))
    return out


def packed(sorted_hashes: np.ndarray) -> bytes:
    """Ascending hashes: the first, then the differences as five low bytes each and their high parts compressed."""
    rest = np.diff(sorted_hashes).astype("<u8")
    high = zlib.compress((rest >> np.uint64(40)).astype("<u4").tobytes(), 1)
    low = rest.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    return sorted_hashes[:1].astype("<u8").tobytes() + len(rest).to_bytes(4, "little") + low + high


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[8:12], "little")
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8, 5 * n, 12).reshape(n, 5)
    high = np.frombuffer(zlib.decompress(data[12 + 5 * n :]), "<u4").astype(np.uint64) << np.uint64(40)
    return np.cumsum(np.concatenate([np.frombuffer(data, "<u8", 1), wide.view("<u8").ravel() | high]), dtype=np.uint64)


def small(counts: np.ndarray) -> bytes:
    """Non-negative integers in one byte each if they fit, else in eight; the first byte is the width."""
    return b"\x01" + counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b"\x08" + counts.astype("<i8").tobytes()


def large(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if data[0] == 1 else "<i8", offset=1).astype(np.int64)


class Block:
    """The distinct n-grams of a block of texts: per order sorted hashes, own training counts, and each token's place.

    ``training`` is the number of times that a text counts.
    """

    def __init__(self, texts: Sequence[bytes | None], training: np.ndarray, order: int):
        self.token, self.first = tokens(texts)
        self.sizes = np.diff(np.append(self.first, len(self.token)))
        weight = np.repeat(training, self.sizes).astype(np.int64)
        self.there, self.hashes, self.own, self.place = [], [], [], []
        for hashed, there in ngrams(self.token, self.first, order):
            distinct, place = np.unique(hashed, return_inverse=True)
            self.there.append(there)
            self.hashes.append(distinct)
            self.own.append(np.bincount(place, weight * there, len(distinct)).astype(np.int64))
            self.place.append(place.astype(np.int32))

    def cuts(self, n: int, buckets: int) -> np.ndarray:
        """Where each bucket's slice of the n-th order's hashes begins."""
        edges = ((np.arange(buckets, dtype=object) << 64) + buckets - 1) // buckets
        return np.append(np.searchsorted(self.hashes[n], edges.astype(np.uint64)), len(self.hashes[n]))


class Automaton:
    """States, arcs and failure arcs that the texts of a block can take.

    State 0 is the root; then come the n-grams shorter than the order, by length and hash, of which those seen in
    training are reached.  A state of n tokens has an arc for each seen n-gram of n + 1 tokens that begins with it, so
    arcs are numbered by those n-grams.  Every word of the block has an arc from the root, unknown ones with the
    probability of their class.  ``step[n]`` and ``after[n]`` are, for each token, log10 of the probability of the arc
    that a state of n tokens has for it there, and the state that it leads to, -1 without such an arc.
    """

    def __init__(self, block: Block, totals: Sequence[np.ndarray], stats: tuple[int, int, int, int], backoff: Sequence[float]):
        n_tokens, kinds, once, twice = stats
        d = once / (once + 2 * max(twice, 1)) if once else 0.5
        order, known = len(backoff) + 1, totals[0] > 0
        state = np.cumsum([1, *map(len, block.hashes[: order - 1])])  # of the first n-gram of each length
        p = np.where(known, totals[0] - d, d * kinds) / n_tokens
        to = np.where(known & (order > 1), state[0] + np.arange(len(p)), 0)
        self.step, self.after = [np.log10(p)[block.place[0]]], [to[block.place[0]]]
        fail, penalty = [np.zeros(1, np.int64)], [np.zeros(1)]
        end = int(block.place[0][block.sizes[0] - 1])  # an end is in every text
        begins = np.zeros(len(block.token), bool)
        begins[block.first] = True
        shorter_state = np.zeros(len(p), np.int64)  # of an n-gram without its first token
        for n, m in enumerate(backoff, start=1):
            count = totals[n - 1]
            fail.append(shorter_state)
            penalty.append(np.log10(m / (count + m)))
            # an occurrence of each n-gram of n + 1 tokens tells its context and its shorter form
            at = np.full(len(block.hashes[n]), -1)
            some = np.flatnonzero(block.there[n])
            at[block.place[n][some]] = some
            j = np.flatnonzero((at >= 0) & (totals[n] > 0))
            i = at[j]
            context = np.where(begins[i], end, block.place[n - 1][i - 1]) if n == 1 else block.place[n - 1][i - 1]
            shorter = block.place[n - 1][i]
            grown, to, longer = np.ones(len(at)), np.full(len(at), -1), np.zeros(len(at), np.int64)
            grown[j] = (totals[n][j] + m * p[shorter]) / (count[context] + m)
            longer[j] = state[n - 1] + shorter
            to[j] = state[n] + j if n < order - 1 else longer[j]
            self.step.append(np.log10(grown)[block.place[n]])
            self.after.append(np.where(block.there[n], to[block.place[n]], -1))
            p, shorter_state = grown, longer
        self.fail, self.penalty = np.concatenate(fail), np.concatenate(penalty)
        self.size = np.repeat(np.arange(order, dtype=np.uint8), [1, *map(len, block.hashes[: order - 1])]).tobytes()  # tokens of a state
        self.start = int(state[0]) + end if order > 1 and known[end] else 0

    def score(self, first: int, last: int) -> float:
        """log10 of the probability of the text of the tokens first to last, in one traversal that carries the state."""
        arcs = zip(*(x[first:last].tolist() for pair in zip(self.after, self.step, strict=True) for x in pair), strict=True)
        fail, penalty, size = self.fail, self.penalty, self.size
        state, total = self.start, 0.0
        for arc in arcs:
            n = 2 * size[state]
            to = arc[n]
            while to < 0:
                total += penalty[state]
                state = fail[state]
                n -= 2
                to = arc[n]
            total += arc[n + 1]
            state = to
        return float(total)


def score_documents(docs: DataFrame, training: Column, backoff: Sequence[float] = BACKOFF, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, training, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "model")
    order = len(backoff) + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), training.alias("training"), F.lit(1).cast("long").alias("copies"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", F.isnull("doc_id"), "text"))
    sizes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    keys = scratch.keep(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(sizes).alias("bytes")), "keys")
    total, most, heavy = keys.agg(F.sum("bytes"), F.max("n"), F.count_if(F.col("n") > COPIES)).first()
    total = total or 0
    if heavy:  # rows that are equal share a block: so many are counted before they are dealt
        many = bounded(keys.where(F.col("n") > COPIES).select("key"), heavy)
        once = rows.join(many, "key", "left_semi").groupBy("key", "doc_id", "text", "training").agg(F.count(F.lit(1)).alias("copies"))
        rows = rows.join(many, "key", "left_anti").unionByName(once)
    blocks = max(partitions(spark), -(-total // block_bytes))
    buckets = max(partitions(spark), -(-total // BUCKET_BYTES))
    dealt = rows.withColumn("block", F.pmod("key", F.lit(blocks))).drop("key")
    asked = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("bucket", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
    told = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("bucket", pa.int64()), ("places", pa.binary()), ("totals", pa.binary()), ("stats", pa.list_(pa.int64()))])
    scores = pa.schema([("doc_id", pa.int64()), ("training", pa.bool_()), ("copies", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def read(table: pa.Table) -> Block:
        return Block(table.column("text").to_pylist(), np.array(table.column("training").to_pylist(), bool) * table.column("copies").to_numpy(), order)

    def ask(table: pa.Table) -> pa.Table:
        block, name = read(table), table.column("block")[0].as_py()
        rows = []
        for n in range(order):
            cuts = block.cuts(n, buckets)
            for bucket in np.flatnonzero(np.diff(cuts)).tolist():
                s = slice(int(cuts[bucket]), int(cuts[bucket + 1]))
                rows.append((name, n, bucket, packed(block.hashes[n][s]), small(block.own[n][s])))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(asked)], schema=asked)

    def add(table: pa.Table) -> pa.Table:
        """Sum a bucket's counts and tell each block the totals that differ from its own counts."""
        blocks, n, bucket = table.column("block").to_pylist(), table.column("n")[0].as_py(), table.column("bucket")[0].as_py()
        parts = [unpacked(x) for x in table.column("hashes").to_pylist()]
        own = [large(x) for x in table.column("counts").to_pylist()]
        distinct, place = np.unique(np.concatenate(parts), return_inverse=True)
        sums = np.bincount(place, np.concatenate(own), len(distinct)).astype(np.int64)  # exact below 2^53
        rows, at = [], 0
        for name, mine in zip(blocks, own, strict=True):
            whole = sums[place[at : at + len(mine)]]
            at += len(mine)
            news = np.flatnonzero(whole != mine)
            if len(news):
                rows.append((name, n, bucket, small(np.diff(news, prepend=0)), small(whole[news]), None))
        if n == 0:
            rows.append((-1, n, bucket, None, None, [int(sums.sum()), int((sums > 0).sum()), int((sums == 1).sum()), int((sums == 2).sum())]))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(told)], schema=told)

    requests = dealt.groupBy("block").applyInArrow(ask, "block long, n int, bucket long, hashes binary, counts binary")
    answers = requests.groupBy("n", "bucket").applyInArrow(add, "block long, n int, bucket long, places binary, totals binary, stats array<long>")
    answers = scratch.keep(answers, "answers")
    sums = answers.where("block < 0").agg(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(4)]).first()
    stats = tuple(int(x) for x in sums)

    def score(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return scores.empty_table()
        block = read(texts)
        totals = [own.copy() for own in block.own]
        cuts = [block.cuts(n, buckets) for n in range(order)]
        for n, bucket, places, values in zip(*(replies.column(c).to_pylist() for c in ("n", "bucket", "places", "totals")), strict=True):
            totals[n][cuts[n][bucket] + np.cumsum(large(places))] = large(values)
        known = totals[0][block.place[0]] > 0
        model, base = np.zeros(len(block.first)), np.zeros(len(block.first))
        if stats[0]:
            machine = Automaton(block, totals, stats, backoff)
            cut = [*block.first.tolist(), len(block.token)]
            model = np.array([machine.score(i, j) for i, j in zip(cut, cut[1:], strict=False)])
            base = np.add.reduceat(np.log10((totals[0] + 1) / (stats[0] + stats[1] + 1))[block.place[0]], block.first)
        n_known = np.add.reduceat(known.astype(np.int64), block.first)
        told = [texts.column(c).combine_chunks() for c in ("doc_id", "training", "copies")]
        return pa.Table.from_arrays([*told, pa.array(block.sizes, pa.int64()), pa.array(n_known), pa.array(base), pa.array(model)], schema=scores)

    replies = answers.where("block >= 0").drop("stats")
    out = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, "doc_id long, training boolean, copies long, n_tokens long, n_known long, base_score double, score double")
    if heavy:
        out = enumerated(out, F.lit(0).cast("long"), F.col("copies"), "_copy", most).drop("_copy")
    return out.drop("copies").withColumn("train_tokens", F.lit(stats[0]).cast("long"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the bigram automaton of those whose crc32(doc_id) mod 7 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out_fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    scored = score_documents(docs, ~out_fold)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
