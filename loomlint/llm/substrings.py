"""Substring dedup by content-defined chunking.

A gear rolling hash over the UTF-8 bytes (16-bit, so its window is 16 bytes) ends a chunk where it falls below a
threshold, on average every ``AVERAGE`` bytes; an insertion shifts bytes but moves only the boundaries next to it.
Chunks are deduplicated by digest across documents: the smallest doc_id that holds a chunk keeps it.  Single small
chunks are common phrases, so only runs of consecutive repeated chunks of ``MIN_WORDS`` words or more count as repeated
passages.  What a passage has before its first boundary and after its last is not in its run, and may be most of it.  So
a shorter run is extended byte by byte into its document's and its keeper's text, and counts if the two agree on
``WHOLE`` words or more.  A passage without a whole chunk inside, or whose chunks all have other keepers, is not found.

Defined cases: null and empty texts have no chunks; rows alike in doc_id and text count as one document; a row whose
doc_id does not tell its text (null, or on different texts) is a document of its own, after all others, and its spans
name its text by ``text_key``; what a document repeats within itself only is left alone; an empty table gives an empty
result; chunks end after ``LARGEST`` bytes at the latest, in text without a boundary where the hash is least, so periodic
text is cut at the same phase everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, batch, bounded, grouped_batches, map_arrow

AVERAGE, LARGEST, MIN_WORDS, WINDOW, WHOLE = 24, 256, 25, 16, 50
#: Bytes on each side that a short run is extended at most; past its neighbour chunks nothing can agree.
REACH = 2 * LARGEST
#: A pseudorandom 16-bit value for each byte.
GEAR = np.random.default_rng(2).integers(0, 1 << 16, 256).astype(np.uint16)
#: Documents that their doc_id does not tell get numbers from here on.
UNTOLD = 1 << 62
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash at each byte: sum over the window of GEAR[byte] << age, by doubling."""
    h = GEAR[data]
    for shift in (1, 2, 4, 8):
        older = h[:-shift] << np.uint16(shift)
        h[shift:] += older
    return h


def cut_points(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Chunk starts in the concatenation of texts that begin at ``starts``; its length follows as the last point.

    A boundary needs a whole window within its text, so the cuts of a text never depend on its neighbours.
    """
    n = len(data)
    hashed = gear(data)
    ends = np.flatnonzero(hashed < np.uint16((1 << 16) // AVERAGE)) + 1
    own = starts[np.searchsorted(starts, ends - 1, side="right") - 1]
    points = np.union1d(ends[ends - own >= WINDOW], np.append(starts, n))
    size = np.diff(points)
    far = np.flatnonzero(size > LARGEST)
    more = []
    for i in far.tolist():
        at, end = int(points[i]), int(points[i + 1])
        while end - at > LARGEST:
            at += LARGEST // 2 + 1 + int(hashed[at + LARGEST // 2 : at + LARGEST].argmin())
            more.append(at)
    if more:
        points = np.union1d(points, more)
    return points


def documents(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """doc, id, h, text (binary) of every different document, and whether ``doc`` is not always its doc_id."""
    key = F.xxhash64("text")
    ids = scratch.keep(docs.where("text is not null").select(F.col("doc_id").cast("long").alias("id"), key.alias("h")).groupBy("id", "h").agg(F.count(F.lit(1)).alias("n")), "ids")
    several = scratch.keep(ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(f"id is not null and (n > 1 or id >= {UNTOLD})").select("id"), "several", ids.count())
    again = ids.where("n > 1").select(F.col("id").alias("_id"), F.col("h").alias("_h"))
    n_again, n_none = ids.agg(F.count_if(F.col("n") > 1), F.count_if(F.col("id").isNull())).first()
    n_several = several.count()
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("id"), key.alias("h"), F.col("text").cast("binary").alias("text"))
    if n_again:
        same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
        twice = bounded(again, n_again)
        rows = rows.join(twice, same, "left_anti").unionByName(rows.join(twice, same, "left_semi").dropDuplicates(["id", "h"]))
    if not n_several and not n_none:
        return rows.withColumn("doc", F.col("id")), False
    rows = rows.join(bounded(several.withColumn("_several", F.lit(True)), n_several), "id", "left")
    own = F.lit(UNTOLD) + F.xxhash64("id", F.isnull("id"), "h").bitwiseAND(F.lit(UNTOLD - 1))
    return rows.withColumn("doc", F.when(F.isnull("id") | F.col("_several"), own).otherwise(F.col("id"))).drop("_several"), True


def chunks(texts: DataFrame) -> DataFrame:
    """Of rows (doc, text): doc_id, start, size (bytes), words, around (words of the chunk before, and 1,000 times those of the next), digest
    (64-bit) of every chunk of every text."""
    schema = [("doc_id", pa.int64()), ("start", pa.int64()), ("size", pa.int32()), ("words", pa.int32()), ("around", pa.int32()), ("digest", pa.int64())]
    digest = xxhash.xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                texts = b.column(1).to_pylist()
                data = b"".join(texts)
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                starts = np.cumsum(sizes) - sizes
                ids = np.array(b.column(0))[sizes > 0]
                starts = starts[sizes > 0]
                if not len(starts):
                    continue
                view = np.frombuffer(data, np.uint8)
                points = cut_points(view, starts)
                space = _SPACE[view]
                first = ~space
                first[1:] &= space[:-1]
                first[starts] = ~space[starts]
                words = np.add.reduceat(first, points[:-1], dtype=np.int32)
                at = points.tolist()
                digests = np.array([digest(data[i:j]) for i, j in zip(at, at[1:], strict=False)], np.uint64).view(np.int64)
                own = np.searchsorted(starts, points[:-1], side="right") - 1
                same = own[1:] == own[:-1]
                around = np.zeros(len(own), np.int32)
                around[1:] += words[:-1] * same
                around[:-1] += 1000 * words[1:] * same
                yield batch(schema, doc_id=ids[own], start=points[:-1] - starts[own], size=np.diff(points).astype(np.int32), words=words, around=around, digest=digests)

    return map_arrow(texts.select("doc", "text"), run, "doc_id long, start long, size int, words int, around int, digest long")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, size (bytes), words, keep_doc_id, text_key: passages of a document that an earlier document keeps.

    keep_doc_id is the keeper of the longest chunk of the passage; text_key (xxhash64 of the text) is null where the
    doc_id alone tells the document.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    texts, untold = documents(docs, scratch)
    every = scratch.keep(chunks(texts), "chunks")
    keepers = every.groupBy("digest").agg(F.min("doc_id").alias("keep"), F.max("doc_id").alias("_last")).where("keep <> _last").drop("_last")
    keepers = scratch.keep(keepers, "keepers")
    # a digest may be in a third of all documents: both sides come from files, so adaptive execution can split it
    again = scratch.keep(every.join(keepers, "digest").where("doc_id <> keep").drop("digest"), "repeated")
    scratch.drop("chunks")
    scratch.drop("keepers")
    schema = [("doc_id", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("words", pa.int64()), ("keep_doc_id", pa.int64()), ("short", pa.bool_())]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_batches(batches, ["doc_id"]):
            doc, start, size, words, around, keep = (table.column(c).to_numpy() for c in ("doc_id", "start", "size", "words", "around", "keep"))
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + size[:-1])
            first = np.flatnonzero(new)
            total = np.add.reduceat(words.astype(np.int64), first)
            last = np.append(first[1:], len(doc))
            long = np.flatnonzero(total >= min_words)
            best = [int(first[i] + np.argmax(size[first[i] : last[i]])) for i in long.tolist()]
            f, e = first[long], last[long] - 1
            yield batch(schema, doc_id=doc[f], start=start[f], size=start[e] + size[e] - start[f], words=total[long], keep_doc_id=keep[best] if best else keep[:0], short=np.zeros(len(f), bool))
            # short runs that may be whole with their neighbour chunks: the longest chunk of each keeper
            room = total + around[first] % 1000 + around[last - 1] // 1000
            rows = []
            for i in np.flatnonzero((total < min_words) & (room >= WHOLE)).tolist():
                at: dict[int, int] = {}
                for c in range(int(first[i]), int(last[i])):
                    if keep[c] not in at or size[c] > size[at[keep[c]]]:
                        at[int(keep[c])] = c
                rows += at.values()
            if rows:
                yield batch(schema, doc_id=doc[rows], start=start[rows], size=size[rows].astype(np.int64), words=words[rows].astype(np.int64), keep_doc_id=keep[rows], short=np.ones(len(rows), bool))

    dealt = again.repartition("doc_id").sortWithinPartitions("doc_id", "start", "size")
    ddl = "doc_id long, start long, size long, words long, keep_doc_id long"
    found = scratch.keep(map_arrow(dealt.select("doc_id", "start", "size", "words", "around", "keep"), runs, f"{ddl}, short boolean"), "runs")
    scratch.drop("repeated")
    names = ["doc_id", "start", "size", "words", "keep_doc_id"]
    spans = found.where("not short").select(*names).unionByName(extended(texts, scratch.keep(found.where("short").select(*names), "short"), scratch))
    if not untold:
        return spans.withColumn("text_key", F.lit(None).cast("long"))
    told = texts.where(F.col("doc") >= UNTOLD).select("doc", "id", "h")
    keeper = told.select(F.col("doc").alias("keep_doc_id"), F.col("id").alias("keep_id"))
    spans = spans.join(told.withColumnRenamed("doc", "doc_id"), "doc_id", "left").join(keeper, "keep_doc_id", "left")
    mine, other = (F.when(F.col(c) >= UNTOLD, F.col(i)).otherwise(F.col(c)) for c, i in (("doc_id", "id"), ("keep_doc_id", "keep_id")))
    return spans.select(mine.alias("doc_id"), "start", "size", "words", other.alias("keep_doc_id"), F.col("h").alias("text_key"))


def agreement(mine: bytes, at: int, size: int, other: bytes) -> tuple[int, int, int]:
    """(start, size, words) of the longest passage around mine[at:at+size] that ``other`` has too."""
    best, seed = (at, 0, 0), mine[at : at + size]
    place = other.find(seed) if seed else -1
    while place >= 0:
        lo, hi = 0, size
        while lo < at and lo < place and mine[at - lo - 1] == other[place - lo - 1]:
            lo += 1
        while at + hi < len(mine) and place + hi < len(other) and mine[at + hi] == other[place + hi]:
            hi += 1
        if lo + hi > best[1]:
            best = (at - lo, lo + hi, len(mine[at - lo : at + hi].split()))
        place = other.find(seed, place + 1)
    return best


def extended(texts: DataFrame, short: DataFrame, scratch: Scratch) -> DataFrame:
    """Of ``short`` (a written table of chunks: doc_id, start, size, words, keep_doc_id) the passages around them that hold ``WHOLE`` words."""
    n = short.count()
    texts = texts.select(F.col("doc").alias("doc_id"), "text")
    at = F.greatest(F.col("start") - REACH, F.lit(0))
    window = F.substring("text", (at + 1).cast("int"), (F.col("start") - at + F.col("size") + REACH).cast("int"))
    near = texts.join(bounded(short, n), "doc_id").select("doc_id", at.alias("from"), (F.col("start") - at).alias("at"), "size", F.col("keep_doc_id").alias("keep"), window.alias("mine"))
    near = scratch.keep(near, "windows")
    keepers = short.select(F.col("keep_doc_id").alias("doc_id")).distinct()
    keepers = texts.join(bounded(keepers, n), "doc_id", "left_semi").select(F.col("doc_id").alias("keep"), F.col("text").alias("other"))
    schema = [("doc_id", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("words", pa.int64()), ("keep_doc_id", pa.int64())]

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, begin, at, size, keep, mine, other in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                start, length, words = agreement(mine, at, size, other)
                if words >= WHOLE:
                    rows.append((doc_id, begin + start, length, words, keep))
            yield batch(schema, **{name: [r[i] for r in rows] for i, (name, _) in enumerate(schema)})

    joined = near.join(keepers, "keep").select("doc_id", "from", "at", "size", "keep", "mine", "other")
    found = map_arrow(joined, extend, "doc_id long, start long, size long, words long, keep_doc_id long")
    # a passage may be met through several chunks and keepers
    return found.groupBy("doc_id", "start").agg(F.max(F.struct("size", "words", "keep_doc_id")).alias("r")).select("doc_id", "start", "r.*")


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A UTF-8 text without byte spans (start, size), which are narrowed to whole words."""
    out, at = [], 0
    for start, size in sorted(spans):
        lo, hi = max(start, at), start + size
        while 0 < lo < hi and not (_SPACE[text[lo - 1]] or _SPACE[text[lo]]):
            lo += 1
        while lo < hi < len(text) and not (_SPACE[text[hi - 1]] or _SPACE[text[hi]]):
            hi -= 1
        if lo < hi:
            out.append(text[at:lo])
            if 0 < lo and hi < len(text) and not (_SPACE[text[lo - 1]] or _SPACE[text[hi]]):
                out.append(b" ")  # words on both sides stay apart
            at = hi
    return b"".join([*out, text[at:]])


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from ``text`` (and ``n_chars`` set anew, if there)."""

    @F.pandas_udf("string")
    def cut(text, starts, sizes):
        import pandas as pd

        rows = zip(text, starts, sizes, strict=True)
        return pd.Series([t if t is None or a is None else without(t.encode(), list(zip(a.tolist(), n.tolist(), strict=True))).decode() for t, a, n in rows], dtype=object)

    lists = spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "size")).alias("_spans"))  # of one document
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_id"))  # a struct, so that no name can clash
    plain = lists.where("text_key is null").select(F.col("doc_id").alias("_of"), "_spans")
    joined = rows.join(plain, F.col("_id") == F.col("_of"), "left").select("_row", "_id", "_spans")
    told = lists.where("text_key is not null")
    if spans.where("text_key is not null").limit(1).count():
        told = told.select(F.col("doc_id").alias("_of"), F.col("text_key").alias("_key"), F.col("_spans").alias("_own"))
        same = F.col("_id").eqNullSafe(F.col("_of")) & (F.xxhash64("_row.text") == F.col("_key"))
        joined = joined.join(told, same, "left").select("_row", F.coalesce("_spans", "_own").alias("_spans"))
    # only texts with spans go through Python
    text = F.col("_row.text")
    new = F.when(F.col("_spans").isNotNull() & text.isNotNull(), cut(text, F.col("_spans.start"), F.col("_spans.size"))).otherwise(text)
    out = joined.withColumn("_text", new)
    cols = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(F.col("_spans").isNotNull(), F.char_length("_text").cast("long")).otherwise(F.col("_row.n_chars"))
    return out.select(*[cols[c].alias(c) if c in cols else F.col(f"_row.`{c}`") for c in docs.columns])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated passage of 25 words or more in all documents: where it is and which document keeps it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated_spans(docs)
