"""Mixing sources to target weights.

The words of a source form one stream, which is packed into blocks of a fixed length (``block_words``; what is left at
the end of the stream is one shorter block).  Each output shard draws how many of its slots every source fills from a
multinomial; draws are conditioned on the exact totals, so a source's slots add up to its target.  Slot k of a source
maps through a pseudorandom permutation of the source's whole blocks (a new one for each pass over them; the shorter
block ends a pass), and the blocks are then joined by number.  A source's last slot takes only the first words of its
block, as many as the target still lacks, so targets are met to the word, by small sources too.

Targets: sources share all words by weight; none gets more than ``max_repeats`` times its own words, and the excess is
reshared by weight among the rest.  A block is taken at most once more than any other block of its source, so no
document is taken more than ``max_repeats`` times (rounded up, if that is not a whole number).

The driver holds one row per source (a mixture names a weight for each) and one count per source and output shard.
Everything that grows with the corpus (stream offsets, slots, blocks) stays distributed.

Defined cases: a null source is a source of its own, last in order; a null or empty text has no words and is taken 0
times; a null doc_id is a value like any other; equal rows are counted, and are separate parts of the stream; a source
without words gets no slots; an empty table gives an empty result.  The same rows, parameters and seed give the same
mixture, whatever the session's partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, counted_classes, enumerated, literal_table, partitions, running_offsets, with_sizes


class Source(NamedTuple):
    source_id: int
    name: str | None
    words: int
    weight: int
    target: float
    full: int  # whole blocks
    blocks: int  # and the shorter one at the end
    slots: int
    last: int  # words that the last slot takes


def water_fill(words: Sequence[int], weights: Sequence[float], max_repeats: float) -> list[float]:
    """Share sum(words) by weight; cap each at max_repeats times its words and reshare the excess until none is above."""
    total, caps = float(sum(words)), [max_repeats * w for w in words]
    capped: set[int] = set()
    while True:
        rest = total - sum(caps[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        share = [caps[i] if i in capped else rest * w / weight for i, w in enumerate(weights)]
        over = {i for i in range(len(words)) if i not in capped and share[i] > caps[i]}
        if not over:
            return share
        capped |= over


def plan_sources(sizes: Sequence[tuple[str | None, int]], cycle: Sequence[int] = (1, 2, 3), max_repeats: float = 3.0, block_words: int = 64) -> list[Source]:
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weights = [cycle[i % len(cycle)] for i in range(len(ordered))]
    targets = water_fill([n for _, n in ordered], weights, max_repeats)
    out = []
    for i, ((name, n), w, t) in enumerate(zip(ordered, weights, targets, strict=True)):
        full, blocks = n // block_words, -(-n // block_words)
        passes, rest = divmod(min(round(t), int(max_repeats * n)), n) if n else (0, 0)
        slots = passes * blocks + -(-rest // block_words)
        # in a broken pass the whole blocks come first, so all its slots but the last are whole; else a pass ends with its last block
        last = rest - (-(-rest // block_words) - 1) * block_words if rest else n - (blocks - 1) * block_words
        out.append(Source(i, name, n, w, t, full, blocks, slots, last))
    return out


def draw_counts(sources: Sequence[Source], shards: int, seed: int) -> list[tuple[int, int, int, int]]:
    """(shard, source_id, first slot of the source, slots): multinomial draws per shard that add up to each source's slots."""
    rng = np.random.default_rng(seed)
    left = np.array([s.slots for s in sources], np.int64)
    total = int(left.sum())
    first, out = np.zeros(len(left), np.int64), []
    for shard in range(shards):
        size = total // shards + (shard < total % shards)
        drawn = np.zeros(len(left), np.int64)
        if shard == shards - 1:
            drawn = left.copy()
        while (need := size - int(drawn.sum())) > 0:
            room = left - drawn
            drawn += np.minimum(rng.multinomial(need, room / room.sum()), room)
        out += [(shard, s.source_id, int(a), int(n)) for s, a, n in zip(sources, first, drawn, strict=True) if n]
        first += drawn
        left -= drawn
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..size-1 for each row: a four-round Feistel network on the next even power of two, walked
    until it falls below size, which it does for each index below size."""
    if (index >= size).any():
        raise ValueError("an index is not below its size")
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    value = index.astype(np.uint64)
    todo = np.ones(len(value), bool)
    limit = size.astype(np.uint64)
    while todo.any():
        left, right = value >> half & mask, value & mask
        for turn in range(4):
            x = right * np.uint64(0x9E3779B97F4A7C15) + key.astype(np.uint64) + np.uint64(turn + 1) * np.uint64(0xD1B54A32D192ED03)
            x = (x ^ x >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (x ^ x >> np.uint64(29)) & mask
        value = np.where(todo, left << half | right, value)
        todo &= value >= limit
    return value.astype(np.int64)


def block_permutation(seed: int):
    @F.pandas_udf("long")
    def block_of(index: pd.Series, size: pd.Series, source_id: pd.Series, turn: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            key = (source_id.to_numpy(np.uint64) << np.uint64(24) ^ turn.to_numpy(np.uint64)) * np.uint64(0x2545F4914F6CDD1D) ^ np.uint64(seed)
            return pd.Series(permuted(index.to_numpy(np.int64), size.to_numpy(np.int64), key))

    return block_of


class Mixture(NamedTuple):
    sources: list[Source]
    docs: DataFrame  # key, source_id, size, source_size, target, copies of the row, start (of this copy; null without words)
    slots: DataFrame  # shard, source_id, slot, turn, block, upto (words of the block that the slot takes)
    pieces: DataFrame  # source_id, block, key, start and size (of the document), from_word (in the document), at (in the block), words
    longest: int  # the most copies of a row


def mix(docs: DataFrame, scratch: Scratch, cycle: Sequence[int] = (1, 2, 3), max_repeats: float = 3.0, block_words: int = 64, shards: int = 64, seed: int = 20, key: Sequence[str] = ("doc_id",)) -> Mixture | None:
    """Plan a mixture of ``docs`` (the columns of ``key``, source, text); None if there are no words.

    Rows alike in key, source and number of words are interchangeable.
    """
    spark = docs.sparkSession
    named = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    sized = scratch.keep(counted_classes(with_sizes(docs.select(*key, named.alias("named"), "text"), "text")), "sized")
    groups = sized.groupBy("named").agg(F.sum(F.col("size") * F.col("copies")), F.max("copies")).collect()  # a row per source
    sources = plan_sources([(k[1:] if k[0] == "s" else None, int(n)) for k, n, _ in groups], cycle, max_repeats, block_words)
    longest = max((m for _, _, m in groups), default=0)
    counts = draw_counts(sources, shards, seed)
    if not counts:
        return None
    names = [["n" if s.name is None else f"s{s.name}", s.source_id, s.full, s.blocks, s.slots, s.last, s.words, s.target] for s in sources]
    table = literal_table(spark, names, "named string, source_id int, full bigint, blocks bigint, slots bigint, last bigint, source_size bigint, target double")
    small = lambda df: F.broadcast(df) if len(names) <= 10_000 else df
    known = sized.join(small(table.select("named", "source_id", "source_size", "target")), "named").drop("named")
    weighed = known.where("size > 0").withColumn("_all", F.col("size") * F.col("copies"))
    placed = enumerated(running_offsets(weighed, "source_id", [*key, "size"], "_all", "_first"), F.lit(0).cast("long"), F.col("copies"), "_copy", longest)
    placed = placed.withColumn("start", F.col("_first") + F.col("_copy") * F.col("size")).drop("_first", "_copy", "_all")
    placed = scratch.keep(placed, "placed")
    none = enumerated(known.where("size = 0"), F.lit(0).cast("long"), F.col("copies"), "_copy", longest).withColumn("start", F.lit(None).cast("long")).drop("_copy")
    length, last = F.lit(block_words), F.col("start") + F.col("size") - 1
    pieces = placed.select(*key, "source_id", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor(last / length))).alias("block"))
    lo = F.greatest(F.col("block") * length, F.col("start"))
    hi = F.least((F.col("block") + 1) * length, F.col("start") + F.col("size"))
    pieces = pieces.select("source_id", "block", *key, "start", "size", (lo - F.col("start")).alias("from_word"), (lo - F.col("block") * length).alias("at"), (hi - lo).alias("words"))
    drawn = literal_table(spark, counts, "shard int, source_id int, first bigint, n bigint").repartition("shard", "source_id")
    drawn = drawn.join(small(table.select("source_id", "full", "blocks", F.col("slots").alias("_slots"), "last")), "source_id")
    # long runs are cut before they are spread, so that no task enumerates a source alone
    run, total = 50_000, sum(s.slots for s in sources)
    runs = drawn.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / run))).alias("_run"))
    wide = max(min(partitions(spark), total // run + 1), total // 1_000_000 + 1)
    runs = runs.repartition(wide, "shard", "source_id", "_run")
    slots = runs.select("*", F.explode(F.sequence(F.col("first") + F.col("_run") * run, F.col("first") + F.least(F.col("n"), (F.col("_run") + 1) * run) - 1)).alias("slot"))
    slots = slots.withColumn("turn", F.floor(F.col("slot") / F.col("blocks")))
    index = F.col("slot") - F.col("turn") * F.col("blocks")
    upto = F.when(F.col("slot") == F.col("_slots") - 1, F.col("last")).otherwise(F.lit(block_words)).cast("long")
    # whole blocks are permuted; the shorter one keeps its place at the end of a pass
    size = F.greatest("full", F.lit(1).cast("long"))
    within = F.least("_at", size - 1)  # the function is asked for all rows, and knows numbers below the size only
    block = F.when(F.col("_at") < F.col("full"), block_permutation(seed)(within, size, F.col("source_id"), F.col("turn"))).otherwise(F.col("full"))
    slots = slots.withColumn("_at", index).select("shard", "source_id", "slot", "turn", block.alias("block"), upto.alias("upto"))
    slots = scratch.keep(slots, "slots")  # written: the planner takes an exploded literal for a tiny table, and would broadcast it
    return Mixture(sources, placed.unionByName(none), slots, pieces, longest)


#: Words of a piece that a slot takes.
_TAKEN = "greatest(0L, least(words, upto - at))"


def taken_words(mixture: Mixture) -> DataFrame:
    """Per document row: its key, size, source_size, target, taken (words the mixture takes, repeats counted)."""
    times = mixture.slots.groupBy("source_id", "block", "upto").agg(F.count(F.lit(1)).alias("times"))
    took = mixture.pieces.join(times, ["source_id", "block"]).groupBy("source_id", "start").agg(F.sum(F.expr(_TAKEN) * F.col("times")).alias("taken"))
    docs = mixture.docs.join(took, ["source_id", "start"], "left")
    return docs.withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).drop("source_id", "start", "copies")


def _one_of_each(docs: DataFrame, mixture: Mixture, key: Sequence[str]) -> DataFrame:
    """``docs`` with one row for each key; rows that occur once are not shuffled for it."""
    if mixture.longest <= 1:
        return docs
    several = mixture.docs.where("copies > 1").select(*key).distinct()
    return docs.join(several, list(key), "left_anti").unionByName(docs.join(several, list(key), "left_semi").dropDuplicates(list(key)))


def _row_key(docs: DataFrame) -> list:
    """Two hashes of a whole row, that tell nulls from each other's columns: rows alike in them are equal."""
    flags = [F.col(f"`{c}`").isNull() for c in docs.columns]
    cols = [F.col(f"`{c}`") for c in docs.columns]
    return [F.xxhash64(*cols, *flags).alias("_k1"), F.hash(*reversed(cols), *flags).alias("_k2")]


def _words(text: str):
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")


def mixed_blocks(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The mixture's output: shard, source_id, slot, turn, block, start, doc_id, text (the words of the block that come
    from the document, joined by spaces)."""
    keyed = docs.select("*", *_row_key(docs))
    mixture = mix(keyed, scratch, key=("_k1", "_k2"), **options)
    if mixture is None:
        empty = F.lit(0).cast("long")
        return docs.limit(0).select(F.lit(0).alias("shard"), F.lit(0).alias("source_id"), empty.alias("slot"), empty.alias("turn"), empty.alias("block"), empty.alias("start"), "doc_id", "text")
    texts = _one_of_each(keyed.select("_k1", "_k2", "doc_id", "text"), mixture, ("_k1", "_k2"))
    parts = mixture.pieces.join(texts, ["_k1", "_k2"]).withColumn("_part", F.slice(_words("text"), (F.col("from_word") + 1).cast("int"), F.col("words").cast("int")))
    cut = mixture.slots.join(parts, ["source_id", "block"]).withColumn("_n", F.expr(_TAKEN)).where("_n > 0")
    text = F.array_join(F.slice("_part", F.lit(1), F.col("_n").cast("int")), " ")
    return cut.select("shard", "source_id", "slot", "turn", "block", "start", "doc_id", text.alias("text"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture as documents: a row for each document row and pass over its source that takes words of it.

    A pass that takes all words keeps the text as it is; else the words taken stand in their order, joined by spaces.
    Columns are those of ``docs`` (n_chars is set anew).  Rows are told apart by all their columns, so a null or repeated
    doc_id is no matter, and of equal rows each has its own passes.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    key = ["_k1", "_k2"]
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), *_row_key(docs))  # a struct, so that no name can clash
    mixture = mix(keyed.select(*key, "_row.source", "_row.text"), scratch, key=key, **options)
    if mixture is None:
        return docs.limit(0)
    parts = mixture.slots.select("source_id", "block", "turn", "upto").join(mixture.pieces, ["source_id", "block"])
    parts = parts.withColumn("words", F.expr(_TAKEN)).where("words > 0")
    part = F.struct("from_word", "words")
    taken = parts.groupBy("source_id", "start", *key, "size", "turn").agg((F.sum("words") == F.col("size")).alias("_whole"), F.array_sort(F.collect_list(part)).alias("_parts"))  # of one document
    text = F.col("_row.text")
    both = _one_of_each(keyed, mixture, key).join(taken.select(*key, "_whole", "_parts"), key)
    cut = both.withColumn("_words", F.when(~F.col("_whole"), _words("_row.text")))
    some = F.array_join(F.flatten(F.transform("_parts", lambda p: F.slice("_words", (p["from_word"] + 1).cast("int"), p["words"].cast("int")))), " ")
    out = cut.withColumn("_text", F.when(F.col("_whole"), text).otherwise(some))
    new = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"_row.`{c}`") for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, sources weighing 1, 2, 3 in turn, at most 3 times their words; 64 output shards."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    mixture = mix(docs, Scratch(spark, "mix"))
    if mixture is None:
        size = F.lit(0).cast("long")
        return docs.select("doc_id", size.alias("size"), size.alias("source_size"), F.lit(0.0).alias("target"), size.alias("taken"))
    return taken_words(mixture).select("doc_id", "size", "source_size", "target", "taken")
