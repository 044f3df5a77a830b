import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from loomlint.llm import _common, mixing, packing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, lang string, shard int, start long, _n int"


def rows(n=300, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        text = " ".join(f"w{x}" for x in rng.integers(0, 50, rng.integers(0, 60)))
        out.append((i, text, f"s{i % 3}" if i % 5 else "big", "en", 7, 8, 9))
    return [*out, (n, None, None, None, 1, 1, 1), (n + 1, "", "s1", None, 1, 1, 1), (None, "a b c", "s1", "en", 1, 1, 1), (5, "same row", "s1", "en", 1, 1, 1), (5, "same row", "s1", "en", 1, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


# -- ring


def placed(df, **options):
    return sharding.ring_shards(df.selectExpr("doc_id", "coalesce(octet_length(text), 0) + 1L as size", "crc32(cast(coalesce(text, '') as binary)) as crc"), "doc_id", ["size", "crc"], **options).collect()


def ring_by_hand(counts, owners, room):
    """Each arc's rows in turn to the next point with room, one at a time, in steps around the ring."""
    left, room, got = dict(enumerate(counts)), list(room), Counter()
    for step in range(len(owners)):
        for arc in range(len(owners)):
            shard = owners[(arc + step) % len(owners)]
            while left[arc] and room[shard]:
                left[arc] -= 1
                room[shard] -= 1
                got[arc, shard] += 1
    return got


def test_flow_fills_every_shard_to_its_capacity():
    rng = np.random.default_rng(3)
    for _ in range(20):
        owners = list(rng.integers(0, 5, 40))
        owners[:5] = range(5)
        counts = [int(x) for x in rng.integers(0, 30, 40)]
        room = sharding.capacities(sum(counts), 5, 0)
        moves = sharding.flow(counts, owners, room)
        got = Counter()
        for arc, lo, hi, shard, _first in moves:
            got[arc, shard] += hi - lo
        assert got == ring_by_hand(counts, owners, room)
        used = defaultdict(list)
        for _arc, lo, hi, shard, first in moves:
            used[shard].append((first, first + hi - lo))
        for spans in used.values():
            spans.sort()
            assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_counts_differ_by_one_and_slots_are_gapless(docs):
    got = placed(docs, shards=16, vnodes=8)
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
    assert len(got) == docs.count()
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert sorted(map(str, got)) == sorted(map(str, placed(docs, shards=16, vnodes=8)))


def test_slack_moves_few_rows_when_a_shard_is_added(spark):
    ids = spark.range(4000).selectExpr("id as doc_id", "'x' as text")
    a = {r.doc_id: r.shard for r in placed(ids, shards=8, vnodes=64, slack=0.2)}
    b = {r.doc_id: r.shard for r in placed(ids, shards=9, vnodes=64, slack=0.2)}
    assert max(Counter(a.values()).values()) <= 1.2 * 4000 / 8 + 1
    assert sum(a[i] != b[i] for i in a) < 0.3 * len(a)


def test_one_key_for_all_rows(spark):
    same = spark.range(500).selectExpr("cast(null as long) as doc_id", "cast(id % 7 as string) as text")
    counts = Counter(r.shard for r in placed(same, shards=16, vnodes=8))
    assert max(counts.values()) - min(counts.values()) <= 1 and sum(counts.values()) == 500


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert placed(none) == []
    assert mixing.mix(none, _common.Scratch(spark, "t")) is None
    assert packing.pack_documents(none).count() == 0


# -- mixing


def test_water_filling():
    assert mixing.water_fill([100, 100, 100], [1, 2, 3], 3) == [50.0, 100.0, 150.0]
    t = mixing.water_fill([10, 1000, 100], [1, 2, 3], 3)
    assert t[0] == 30 or t[0] < 30
    assert abs(sum(t) - 1110) < 1e-6 and t[2] == 300
    assert mixing.water_fill([0, 5], [1, 1], 3) == [0, 5.0]


def test_permutations_are_permutations():
    for size in (1, 2, 3, 7, 64, 1000):
        for key in (0, 12345):
            with np.errstate(over="ignore"):
                got = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, key))
            assert sorted(got.tolist()) == list(range(size))
    with np.errstate(over="ignore"):
        a, b = (mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, k)) for k in (1, 2))
    assert (a != b).mean() > 0.9


def test_draws_add_up():
    sources = mixing.plan_sources([("a", 5000), ("b", 20000), (None, 700)])
    drawn = mixing.draw_counts(sources, 16, 3)
    per = Counter()
    for _shard, s, first, n in drawn:
        assert first == per[s]
        per[s] += n
    assert [per[s.source_id] for s in sources] == [s.slots for s in sources]
    sizes = Counter()
    for shard, _s, _f, n in drawn:
        sizes[shard] += n
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert len({n for _sh, s, _f, n in drawn if s == 1}) > 1  # drawn, not dealt evenly


def test_mixture_meets_its_targets(spark, docs):
    mixture = mixing.mix(docs, _common.Scratch(spark, "t"))
    got = mixing.taken_words(mixture).collect()
    assert len(got) == docs.count()
    sizes = defaultdict(set)
    for r in rows():
        sizes[r[0]].add(len(WORD.findall(r[1] or "")))
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        assert r["size"] in sizes[r.doc_id]
        assert r.taken <= 3 * r["size"]
        by[r.source_size][0] += r.taken
        by[r.source_size][2] = r.target
    for taken, _, target in by.values():
        assert abs(taken - target) <= 64
    again = mixing.taken_words(mixing.mix(docs, _common.Scratch(spark, "t"))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_slots_take_each_block_evenly(spark, docs):
    mixture = mixing.mix(docs, _common.Scratch(spark, "t"), block_words=16)
    times = {(r.source_id, r.block): r.n for r in mixture.slots.groupBy("source_id", "block").count().withColumnRenamed("count", "n").collect()}
    for s in mixture.sources:
        if s.slots:
            counts = [times.get((s.source_id, b), 0) for b in range(s.blocks)]
            assert sum(counts) == s.slots and max(counts) - min(counts) <= 1


def by_hand(sized, block_words, shards=64, seed=20):
    """The words that each document row (doc_id, source, size) gives, word by word, for rows that are all different."""
    totals = Counter()
    for _i, s, n in sized:
        totals[s] += n
    sources = mixing.plan_sources(list(totals.items()), block_words=block_words)
    out = {}
    for s in sources:
        if not s.slots:
            continue
        taken = Counter()
        for k in range(s.slots):
            turn, at = divmod(k, s.blocks)
            block = s.full
            if at < s.full:
                with np.errstate(over="ignore"):
                    key = (np.array([s.source_id], np.uint64) << np.uint64(24) ^ np.array([turn], np.uint64)) * np.uint64(0x2545F4914F6CDD1D) ^ np.uint64(seed)
                    block = int(mixing.permuted(np.array([at]), np.array([s.full]), key)[0])
            n = min(block_words, s.words - block * block_words)
            for w in range(s.last if k == s.slots - 1 else n):
                taken[block * block_words + w] += 1
        assert sum(taken.values()) == min(round(s.target), 3 * s.words)
        out[s.name] = taken
    return out


@pytest.mark.parametrize("block_words", [8, 64])
def test_words_taken_by_hand(spark, block_words):
    sized = [(i, r[2], len(WORD.findall(r[1] or ""))) for i, r in enumerate(rows(150))]
    df = spark.createDataFrame([(i, r[1], r[2]) for i, r in enumerate(rows(150))], "doc_id long, text string, source string")
    mixture = mixing.mix(df, _common.Scratch(spark, "t"), block_words=block_words)
    want = by_hand(sized, block_words)
    names = {s.source_id: s.name for s in mixture.sources}
    starts = {(r.doc_id, names[r.source_id]): r.start for r in mixture.docs.collect()}
    for name in {s for _, s, n in sized if n}:  # documents stand one after the other in the stream
        spans = sorted((starts[i, s], n) for i, s, n in sized if s == name and n)
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    got = {r.doc_id: r.taken for r in mixing.taken_words(mixture).collect()}
    assert got == {i: sum(want[s][w] for w in range(starts[i, s], starts[i, s] + n)) if n else 0 for i, s, n in sized}


def test_the_mixture_does_not_depend_on_the_sessions_partitions(spark, docs):
    key = "spark.sql.shuffle.partitions"
    before, got = spark.conf.get(key), []
    for n in (before, "23"):
        spark.conf.set(key, n)
        got.append(sorted(map(str, mixing.taken_words(mixing.mix(docs, _common.Scratch(spark, "t"))).collect())))
    spark.conf.set(key, before)
    assert got[0] == got[1]


ODD = [(None, "a b c d", "s"), (None, "e f", "s"), (1, "g h i", "s"), (5, "q r s t", "s"), (5, "u v w x", "s"), (5, "q r s t", None), (6, "same", "s"), (6, "same", "s"), (7, None, "s"), (8, " \n", "z")]


def test_mixed_documents_with_null_and_repeated_ids(spark):
    """Every word that the mixture takes is in its output, for rows without and with the same doc_id too."""
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in ODD * 3], "doc_id long, text string, source string, _n int, _k1 int, start int")
    got = mixing.mixed_documents(df, block_words=2, cycle=(1,)).collect()
    assert set(got[0].asDict()) == set(df.columns) and all((r._n, r._k1, r.start) == (1, 2, 3) for r in got)
    # with weights alike every source keeps its share, so some pass takes every word
    sizes = Counter()
    for r in ODD * 3:
        sizes[r[2]] += len((r[1] or "").split())
    targets = {s.name: round(s.target) for s in mixing.plan_sources(list(sizes.items()), (1,))}
    taken = Counter()
    for r in got:
        taken[r.source] += len(r.text.split())
    assert taken == {k: n for k, n in targets.items() if n}
    words = {(r[0], r[2], r[1]) for r in ODD}
    assert all(any((r.doc_id, r.source) == (i, s) and not Counter(r.text.split()) - Counter((t or "").split()) for i, s, t in words) for r in got)
    whole = mixing.mixed_documents(df.where("source = 's'"), block_words=2).collect()  # one source: every row once
    assert Counter((r.doc_id, r.text) for r in whole) == Counter((r[0], r[1]) for r in ODD * 3 if r[2] == "s" and r[1])


def test_mixed_documents_hold_the_words_taken(spark):
    docs = spark.createDataFrame([r[:4] + (len(r[1] or ""),) for r in rows(200)], "doc_id long, text string, source string, lang string, n_chars long")
    texts = {(r.doc_id, r.source): r.text for r in docs.collect()}
    totals, got = Counter(), Counter()
    for r in docs.collect():
        totals[r.source] += len(WORD.findall(r.text or ""))
    for r in mixing.mixed_documents(docs, block_words=8).collect():
        words = WORD.findall(r.text)
        got[r.source] += len(words)
        assert not Counter(words) - Counter(WORD.findall(texts[r.doc_id, r.source])) and r.n_chars == len(r.text)
    assert got == {s.name: min(round(s.target), 3 * s.words) for s in mixing.plan_sources(list(totals.items())) if s.slots}


def test_mixed_blocks_hold_the_block_of_each_slot(spark):
    docs = spark.createDataFrame([r[:3] for r in rows(60)], "doc_id long, text string, source string")
    totals, texts = Counter(), defaultdict(list)
    for r in docs.collect():
        totals[r.source] += len(WORD.findall(r.text or ""))
        texts[r.doc_id].append(" ".join(WORD.findall(r.text or "")))
    sources = {s.source_id: s for s in mixing.plan_sources(list(totals.items()), block_words=8)}
    size = Counter()
    for r in mixing.mixed_blocks(docs, _common.Scratch(spark, "t"), block_words=8).collect():
        assert any(r.text in t for t in texts[r.doc_id])
        size[r.source_id, r.slot, r.block] += len(r.text.split())
    assert len(size) == sum(s.slots for s in sources.values())
    for (source, slot, block), n in size.items():
        s = sources[source]
        assert n == (s.last if slot == s.slots - 1 else min(8, s.words - block * 8))


# -- packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_pieces_are_the_tokenizers_ids(spark, docs, tokenizer):
    long = spark.createDataFrame([(900, "naïve Ünïcode 東京 <|endoftext|> " * 500, "s", "en", 0, 0, 0)], DOCS)
    got = defaultdict(list)
    for r in packing.token_pieces(docs.where("doc_id is not null and doc_id <> 5").unionByName(long), with_ids=True).collect():
        got[r.doc_id].append(r)
    texts = {r[0]: r[1] for r in rows() if r[0] is not None and r[0] != 5} | {900: long.first().text}
    for doc_id, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(got[doc_id], key=lambda r: r.piece)
        assert [x for r in pieces for x in r.ids] == ids
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert all(r.length == 2048 for r in pieces[1:]) and 0 < pieces[0].length <= 2048
        at = 0
        for r in pieces:
            assert r.start == at and r.length == len(r.ids)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += r.length


def test_special_tokens_are_those_of_the_tokenizers_defaults(spark):
    from tokenizers import Tokenizer

    default = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  \n y", "<|endoftext", "don't\u00a0stop 東京 <|endoftext|>é", "plain text  "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for path in (None, public_tokenizers.path("byte_bpe_50k.json")):
        got = {r.doc_id: r.ids for r in packing.token_pieces(df, with_ids=True, path=path).collect()}
        assert got == {i: [*default.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}


def test_very_long_texts(spark, tokenizer):
    texts = [" " * 1_000_000, "a b" + " " * 300_000 + "c", "\n" * 200_000, "ab" * 300_000, "<|endoftext|>" + " " * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(list)
    for r in packing.token_pieces(df, with_ids=True).collect():
        got[r.doc_id].append(r)
    for i, t in enumerate(texts):
        assert [x for r in sorted(got[i], key=lambda r: r.piece) for x in r.ids] == [*tokenizer.encode(t, add_special_tokens=False).ids, 0]


def test_many_equal_rows(spark, monkeypatch):
    """Copies are counted, and enumerated in runs: each gets a place of its own."""
    monkeypatch.setattr(_common, "RUN", 100)
    same = spark.range(5000).selectExpr("cast(if(id % 10 = 0, id, null) as long) as doc_id", "if(id % 10 = 0, 'x y', 'same text') as text", "'s' as source")
    packed = packing.pack_documents(same, capacity=64).collect()
    assert len(packed) == 5000 and len({(r.sequence_id, r.offset) for r in packed}) == 5000
    got = placed(same)
    shards = Counter(r.shard for r in got)
    assert max(shards.values()) - min(shards.values()) <= 1 and len({(r.shard, r.slot) for r in got}) == 5000
    mixture = mixing.mix(same, _common.Scratch(spark, "t"))
    assert sorted(r.start for r in mixture.docs.collect()) == list(range(0, 10_000, 2))
    assert [r.taken for r in mixing.taken_words(mixture).collect()] == [2] * 5000


def best_fit_decreasing(lengths, capacity):
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= x]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - x)
        else:
            n += 1
            gaps.append(capacity - x)
    return n


def test_plans_use_every_piece_once_and_few_sequences():
    rng = np.random.default_rng(7)
    for capacity in (16, 100, 2048):
        for _ in range(8):
            lengths = Counter(int(x) for x in np.minimum(capacity, 1 + rng.exponential(capacity / 4, 400)))
            plan = packing.plan_packing(dict(lengths), capacity)
            used = Counter()
            for pattern, n in plan:
                assert n > 0 and sum(pattern) <= capacity
                for x in pattern:
                    used[x] += n
            assert used == lengths
            n = sum(n for _, n in plan)
            assert n <= best_fit_decreasing(list(lengths.elements()), capacity) * 1.02 + 1


def test_exact_complements_are_found():
    assert packing.plan_packing({2047: 5, 1: 5}) == [((2047, 1), 5)]
    assert packing.plan_packing({1000: 1, 700: 1, 348: 1}) == [((1000, 700, 348), 1)]
    assert packing.plan_packing({1000: 2, 500: 2, 400: 2, 148: 2}) == [((1000, 500, 400, 148), 2)]
    assert packing.plan_packing({1024: 3}) == [((1024, 1024), 1), ((1024,), 1)]


def test_packed_sequences(spark, docs):
    got = packing.pack_documents(docs, capacity=64).collect()
    pieces = packing.token_pieces(docs, 64).count()
    assert len(got) == pieces
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
        assert sum(n for _, n in spans) <= 64
    assert len(sequences) <= 1.03 * sum(r.length for r in got) / 64 + 2


# -- shared helpers


def test_word_counts():
    import pyarrow as pa

    texts = [None, "", " ", "a", " a", "a ", "a\tb\nc\x0bd\x0ce\rf", "é ü\u00a0x  東京", "x" * 1000 + " ", None, "\x1c a"]
    want = [len(WORD.findall(t or "")) for t in texts]
    assert _common.word_counts(pa.array(texts)).tolist() == want
    assert _common.word_counts(pa.array(["q q", *texts, "z"]).slice(1, len(texts))).tolist() == want
    assert _common.word_counts(pa.array([], pa.string())).tolist() == [] and _common.word_counts(pa.array([None], pa.string())).tolist() == [0]


def test_running_offsets(spark):
    df = spark.createDataFrame([(i % 3 if i % 4 else 0, i, i % 5) for i in range(500)], "g int, k int, w int")
    got = _common.running_offsets(df, "g", ["k"], "w").collect()
    by = defaultdict(list)
    for r in got:
        by[r.g].append((r.start, r.w))
    for spans in by.values():
        spans.sort(key=lambda x: (x[0], x[1] > 0))
        total = 0
        for start, w in spans:
            assert start == total
            total += w
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "101")  # other cells, the same order
    again = _common.running_offsets(df, "g", ["k"], "w").collect()
    spark.conf.set(key, before)
    assert sorted(again) == sorted(got)


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r.node: r.root for r in _common.components(spark.createDataFrame(pairs, "a long, b long"), _common.Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for x in linked}


def test_scratch_tables(spark):
    from pathlib import Path

    scratch = _common.Scratch(spark, "t")
    kept = scratch.keep(spark.range(5).toDF("x"), "a")
    assert kept.count() == 5 and Path(scratch.root, "a", "_SUCCESS").exists()
    scratch.drop("a")
    assert not Path(scratch.root, "a").exists()
    scratch.keep(spark.range(5).toDF("x"), "b")
    _common.clear(spark)
    assert not Path(scratch.root).exists()
