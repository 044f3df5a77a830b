import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomlint.llm import language_model, quality, queries, resemblance, simhash, substrings, token_counts, topk, vectors
from loomlint.llm._common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns whose names operators also use inside.
CLASH = "doc_id long, text string, source string, lang string, digest long, keep int, fp string, block int, root int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "s", "en", 1, 2, "x", 3, 4) for i, t in rows], CLASH)


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(n, seed, vocabulary=3000):
    rng = np.random.default_rng(seed)
    return " ".join(f"{'abcdefghij'[x % 10]}{x}q" for x in rng.integers(0, vocabulary, n))


def roots_of(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# -- SimHash


def fingerprint_by_hand(text):
    w = words_of(text)
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def test_fingerprints(spark):
    texts = ["", None, "One", "two Words", "a b c", "a b c d e f g", "É a\tb\nc\x0bd", prose(500, 1), "x " * 5000]
    got = {r.doc_id: r.fp for r in simhash.fingerprints(docs_of(spark, enumerate(texts))).collect()}
    assert {i: v % (1 << 64) for i, v in got.items()} == {i: fingerprint_by_hand(t) for i, t in enumerate(texts)}
    # the hash is the one that Spark calls xxhash64
    assert spark.sql("select xxhash64('a b c')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("node", [1024, 4])
def test_the_index_loses_no_link(spark, monkeypatch, node):
    monkeypatch.setattr(simhash, "NODE", node)  # small nodes are refined twice, down to eight free bits
    rng = np.random.default_rng(node)
    base = rng.integers(0, 1 << 63, 12)
    fps = set()
    for x in base.tolist():
        for _ in range(40):
            y = x
            for b in rng.integers(0, 64, rng.integers(0, 4)).tolist():
                y ^= 1 << b
            fps.add(y - (1 << 64) if y >> 63 else y)
    fps = sorted(fps)
    linked = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= 2]
    got = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), Scratch(spark, "t")).collect()
    assert roots_of(fps, [(r.a, r.b) for r in got]) == roots_of(fps, linked)


def test_near_duplicates_and_one_of_each(spark):
    long = prose(4000, 3)
    edited = long.replace(long.split()[2000], "changed", 1)
    rows = [(5, long), (3, long), (9, edited), (7, prose(300, 4)), (8, ""), (10, None), (None, long), (None, prose(50, 9)), (7, prose(300, 4))]
    df = docs_of(spark, rows)
    got = list((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(df).collect())
    close = (fingerprint_by_hand(long) ^ fingerprint_by_hand(edited)).bit_count() <= 2
    assert sorted(got, key=str) == sorted([("5", 3), ("3", 3), ("9", 3 if close else 9), ("7", 7), ("7", 7), ("8", 8), ("10", 8), ("None", 3), ("None", None)], key=str)
    kept = Counter(r.doc_id for r in simhash.one_of_each(df).collect())
    assert kept == Counter([3, 7, 8, None])  # the row without an id that is like another goes
    assert simhash.one_of_each(df).columns == df.columns
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_one_of_each_tells_rows_by_id_and_text(spark):
    a, b, c = prose(60, 1), prose(60, 2), prose(60, 3)
    rows = [(7, a, 1, 2), (7, b, 1, 2), (7, b, 3, 4), (2, b.upper(), 5, 6), (None, c, 7, 8), (None, a, 0, 0), (9, None, 0, 0), (None, None, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h1 int, _row int")
    got = sorted(map(tuple, simhash.one_of_each(df).collect()), key=str)
    # one of the components {7 a, null a}, {7 b twice, 2 b}, {null c}, {9, null without words}
    assert got == sorted([(7, a, 1, 2), (2, b.upper(), 5, 6), (None, c, 7, 8), (9, None, 0, 0)], key=str)
    twice = simhash.one_of_each(df.where("doc_id = 7").unionByName(df.where("doc_id = 7"))).collect()
    assert sorted((r.doc_id, r.text) for r in twice) == sorted([(7, a), (7, b)])
    assert simhash.one_of_each(df.limit(0)).columns == df.columns and simhash.one_of_each(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [512, 4])
def test_edited_copies_go_by_exact_similarity(spark, monkeypatch, size):
    monkeypatch.setattr(resemblance, "BUCKET", size)  # small buckets are split into pairs of blocks
    rng = np.random.default_rng(8)
    rows = []
    for family in range(25):
        base = prose(120 + 20 * family, 700 + family).split()
        for n in range(6):
            w = list(base)
            for at in rng.integers(0, len(w), n * len(w) // 120).tolist():
                w[at] = f"edit{family}x{n}y{at}"
            rows.append((100 * family + n, " ".join(w)))
    rows += [(5000, ""), (5001, None), (5002, "a b"), (None, rows[0][1]), (5003, rows[0][1].upper())]

    def grams(text):
        w = words_of(text)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    fine = [(i, fingerprint_by_hand(t), grams(t)) for i, t in rows if i is not None]
    similar = [(a, b) for n, (a, _, s) in enumerate(fine) for b, _, t in fine[:n] if s and t and len(s & t) / len(s | t) >= 0.8]
    close = [(a, b) for n, (a, x, _) in enumerate(fine) for b, y, _ in fine[:n] if (x ^ y).bit_count() <= 2]
    assert len(set(similar) - set(close)) > 20
    want = roots_of([i for i, _, _ in fine], similar + close)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs_of(spark, rows), similarity=0.8).collect()}
    assert got == want | {None: 0}
    kept = [r.doc_id for r in simhash.one_of_each(docs_of(spark, rows), similarity=0.8).collect()]
    assert sorted(i for i in kept if i is not None) == sorted(set(want.values())) and kept.count(None) == 0
    assert simhash.near_duplicates(docs_of(spark, rows).limit(0), similarity=0.8).count() == 0


# -- substrings


def test_cuts_depend_on_the_text_alone():
    text = prose(400, 5).encode()
    view = np.frombuffer(text, np.uint8)
    alone = substrings.cut_points(view, np.array([0]))
    shifted = np.frombuffer(b"some other text" + text, np.uint8)
    after = substrings.cut_points(shifted, np.array([0, 15]))
    assert (after[after >= 15] - 15).tolist() == alone.tolist()
    inserted = b"!!! " + text
    moved = set((substrings.cut_points(np.frombuffer(inserted, np.uint8), np.array([0])) - 4).tolist())
    assert len(set(alone.tolist()) - moved) <= 3  # an insertion moves only the boundaries near it
    assert np.diff(substrings.cut_points(np.zeros(5000, np.uint8), np.array([0]))).max() <= substrings.LARGEST
    # the hash is a sum over the last 16 bytes
    slow = [sum(int(substrings.GEAR[view[i - j]]) << j for j in range(min(i + 1, 16))) % (1 << 16) for i in range(200)]
    assert substrings.gear(view)[:200].tolist() == slow


def test_repeated_passages_are_caught_and_clean_texts_are_not(spark):
    passages = [prose(51 + 10 * i, 100 + i) for i in range(40)]
    rows, want = [], set()
    for i, p in enumerate(passages):
        rows.append((2 * i, f"{prose(80, 200 + i)} {p} {prose(30, 300 + i)}"))
        rows.append((2 * i + 1, f"{prose(17 + i, 400 + i)} {p}"))
        want.add(2 * i + 1)
    rows += [(1000 + i, prose(200, 500 + i)) for i in range(40)] + [(2000, ""), (2001, None), (2002, "ü" * 900)]
    df = docs_of(spark, rows)
    got = substrings.repeated_spans(df).collect()
    assert {r.doc_id for r in got} == want
    texts = dict(rows)
    for r in got:
        assert r.keep_doc_id == r.doc_id - 1
        span = texts[r.doc_id].encode()[r.start : r.start + r.size]
        assert span in texts[r.keep_doc_id].encode() and len(span.split()) >= 20
    out = {r.doc_id: r.text for r in substrings.remove_spans(df, substrings.repeated_spans(df)).collect()}
    assert all(out[i] == texts[i] for i in texts if i not in want and i is not None)
    for i in want:
        assert len(out[i]) < len(texts[i]) and set(out[i].split()) <= set(texts[i].split())
    assert substrings.repeated_spans(df.limit(0)).count() == 0


def test_passages_whose_ends_hold_most_of_them_are_found(spark):
    # long stretches without a boundary at both ends, and at least one whole chunk between
    rows, want, n = [], set(), 0
    for i in range(2000):
        p = " ".join(w[:5] for w in prose(51, 3000 + i).split())
        points = substrings.cut_points(np.frombuffer(p.encode(), np.uint8), np.array([0]))[1:-1]
        if len(points) >= 2 and len(p.encode()[points[0] : points[-1]].split()) < 22:
            rows += [(2 * n, f"{prose(60, 9000 + i)} {p} {prose(30, 12000 + i)}"), (2 * n + 1, f"{prose(25, 15000 + i)} {p} {prose(20, 18000 + i)}")]
            want.add(2 * n + 1)
            n += 1
    assert n >= 3
    got = substrings.repeated_spans(docs_of(spark, rows)).collect()
    assert {r.doc_id for r in got} == want
    texts = dict(rows)
    for r in got:
        span = texts[r.doc_id].encode()[r.start : r.start + r.size]
        assert r.keep_doc_id == r.doc_id - 1 and span in texts[r.keep_doc_id].encode() and len(span.split()) >= 25


def test_whole_copies(spark):
    text = prose(120, 1)
    got = substrings.repeated_spans(docs_of(spark, [(4, text), (2, text), (2, text), (9, text)])).collect()
    assert sorted((r.doc_id, r.keep_doc_id, r.start, r.size) for r in got) == [(4, 2, 0, len(text)), (9, 2, 0, len(text))]


def test_periodic_text_is_cut_at_one_phase(spark):
    rows = [(i, prose(20 + i, 40 + i) + " " + w * 400 + prose(9, 60 + i)) for i, w in enumerate(["and "] * 6 + ["a"] * 3 + ["ab cde, "] * 3)]
    got = substrings.repeated_spans(docs_of(spark, rows)).collect()
    longest = Counter()
    for r in got:
        longest[r.doc_id] = max(longest[r.doc_id], r.size)
    assert {i for i in longest if rows[i][1].count(" ") > 50} == {1, 2, 3, 4, 5, 9 + 1, 9 + 2}
    assert all(longest[i] > 0.75 * len(w) * 400 for i, w in [(1, "and "), (5, "and "), (10, "ab cde, "), (11, "ab cde, ")])


def test_spans_belong_to_a_text(spark):
    """Repeated and null ids: each different text has its own spans, equal rows the same ones."""
    p, q = prose(80, 1), prose(90, 2)
    first, second, third = f"{prose(30, 3)} {p}", f"{p} {prose(300, 4)}", f"{prose(120, 5)} {q} {prose(5, 6)}"
    rows = [(1, p), (3, q), (5, first), (5, second), (5, third), (5, third), (None, fourth := f"{prose(30, 33)} {q}"), (None, "x y"), (6, p), (6, p)]
    df = spark.createDataFrame([(*r, 1, "s", 7) for r in rows], "doc_id long, text string, start int, _spans string, n_chars long")
    spans = substrings.repeated_spans(df)
    by_text = {(i, t): [] for i, t in rows}
    for r in spans.collect():
        texts = [t for i, t in set(rows) if i == r.doc_id and (r.text_key is None or r.text_key == spark.range(1).select(F.xxhash64(F.lit(t))).first()[0])]
        assert len(texts) == 1 and r.keep_doc_id in (1, 3)
        span = texts[0].encode()[r.start : r.start + r.size]
        assert span in (p if r.keep_doc_id == 1 else q).encode()
        by_text[r.doc_id, texts[0]].append(len(span.split()))
    assert {k: len(v) for k, v in by_text.items()} == {(1, p): 0, (3, q): 0, (5, first): 1, (5, second): 1, (5, third): 1, (None, fourth): 1, (None, "x y"): 0, (6, p): 1}
    assert min(n for v in by_text.values() for n in v) > 60
    out = substrings.remove_spans(df, spans).collect()
    assert set(out[0].asDict()) == set(df.columns) and len(out) == len(rows)
    ends = Counter()
    for r in out:
        shared = max(sum((Counter(r.text.split()) & Counter(x.split())).values()) for x in (p, q))
        ends[r.doc_id, shared > 70] += 1
        assert shared > 70 or shared < 40
    assert ends == {(1, True): 1, (3, True): 1, (5, False): 4, (None, False): 2, (6, False): 2}
    assert all(r.n_chars == len(r.text) for r in out if r.doc_id in (5, 6)) and {r.start for r in out} == {1}


def test_spans_are_cut_at_words():
    assert substrings.without("aa bbb cc dd".encode(), [(1, 7)]).decode() == "aa cc dd"
    assert substrings.without("äö üü äö".encode(), [(5, 5)]).decode() == "äö äö"
    assert substrings.without(b"abc", [(0, 3)]) == b""


# -- quality


def split(good, mixed):
    """Rows as a table holds them: positives are among the unlabelled texts."""
    return quality.total_over(np.vstack([good, mixed]), np.arange(len(good) + len(mixed)) < len(good))


def test_the_risk_is_non_negative_learning():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (300, 5)), rng.normal(-1.5, 1, (500, 5))
    mixed = np.vstack([rng.normal(1, 1, (1700, 5)), bad])
    model = quality.fit(split(good, mixed), 5, 0.8)
    assert (model.score(rng.normal(1, 1, (1000, 5))) >= 0.5).mean() > 0.95
    assert (model.score(rng.normal(-1.5, 1, (1000, 5))) < 0.5).mean() > 0.9
    assert quality.fit(split(np.zeros((0, 5)), mixed), 5, 0.5).score(mixed).tolist() == [0.5] * len(mixed)


def test_steps_go_down_the_risk_and_its_second_term_stays_non_negative():
    """The risk by its definition, with every text in memory."""
    rng = np.random.default_rng(4)
    good, mixed = rng.normal(0.5, 1, (60, 8)), np.vstack([rng.normal(0.5, 1, (150, 8)), rng.normal(-0.5, 1, (60, 8))])
    every, p = np.vstack([good, mixed]), 0.7
    loss = lambda f: np.logaddexp(0, -f)
    risks = []
    for steps in range(7):
        m = quality.fit(split(good, mixed), 8, p, 0.01, steps)
        f, g = ((x - m.mean) / m.scale @ m.weights + m.bias for x in (every, good))
        rest = loss(-f).mean() - p * loss(-g).mean()
        assert rest >= -1e-6
        risks.append(p * loss(g).mean() + max(0, rest) + (0.01 + 9 / len(every)) * (m.weights @ m.weights + m.bias**2) / 2)
    assert risks[0] == pytest.approx(math.log(2)) and all(a >= b - 1e-9 for a, b in zip(risks, risks[1:], strict=False)) and risks[-1] < 0.9 * risks[0]


def test_sums_over_a_table_are_those_in_memory(spark):
    """The distributed fit against the same fit of rows in memory, all texts and all positives; odd rows included."""
    rows = [(i, prose(30 + i % 50, i) if i % 3 else "$$ !! AA " * (i % 20)) for i in range(240)] + [(5, "other text"), (5, None), (None, "x y z"), (300, "")]
    df, labels = docs_of(spark, rows), spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(0, 240, 2)] + [(4, 0), (None, 1), (7, None)], "doc_id long, quality int")
    got = quality.train(df, labels)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    known = {i for i in range(0, 240, 2) if i % 3 and not held(i)}
    mine = [(i, quality.features((t or "").encode() if t is not None else None)) for i, t in rows if not held(i)]
    x, pos = np.array([f for _, f in mine], np.float64), np.array([i in known for i, _ in mine])
    told = [q for i, q in [(i, int(i % 3 != 0)) for i in range(0, 240, 2)] + [(4, 0)] if not held(i)]
    want = quality.fit(quality.total_over(x, pos), quality.N_FEATURES, float(np.mean(told)))
    assert np.allclose(got.mean, want.mean) and np.allclose(got.weights, want.weights, atol=1e-6) and got.bias == pytest.approx(want.bias, abs=1e-6)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op8_quality"](spark, sf).toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]
    assert (got.predicted == (got.score >= 0.5)).all() and got.score.between(0, 1).all()
    labelled = got[got.held_out].merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert len(labelled) > 50 and (labelled.predicted == labelled.quality).mean() > 0.95


def test_labels_of_the_held_out_fold_are_not_read(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    Scratch(spark, "t")
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs, flipped)
    assert a.weights.tolist() == b.weights.tolist()


def test_features_of_odd_texts(spark):
    for t in (None, b"", b" ", b"\n\n", b"x" * 100_000, "é".encode() * 1000):
        assert quality.features(t).shape == (quality.N_FEATURES,) and np.isfinite(quality.features(t)).all()
    Scratch(spark, "t")
    df = spark.createDataFrame([(1, None, 1), (None, "", 2), (1, None, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    rows = quality.featured(df, labels, Scratch(spark, "t"))
    model = quality.trained(rows, labels)  # no positives
    assert [r.score for r in quality.scored(rows, model).collect()] == [0.5] * 3 and quality.kept_documents(df, model).collect() == df.collect()
    assert quality.kept_documents(df.limit(0), model).columns == df.columns
    assert quality.train(df.limit(0), labels.limit(0)).bias == 0


# -- vectors


def clusters(spark, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(30):
        x = rng.normal(size=64)
        for _ in range(int(rng.integers(1, 8))):
            rows.append((x + rng.normal(size=64) * rng.uniform(0, 0.35)).tolist())
    rows += [rows[0], rows[0], [2 * v for v in rows[3]], [0.0] * 64, None, [float("nan")] + [1.0] * 63, [None] + [1.0] * 63, [1.0, 2.0], [1.0, 2.0], [], [float("inf")] * 64]
    return spark.createDataFrame([(i, v, 7, 8) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, cls int, n int"), rows


def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def links_by_hand(rows):
    linked = []
    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            b = rows[j]
            if fine(a) and fine(b) and len(a) == len(b):
                u, v = np.array(a), np.array(b)
                if u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.9:
                    linked.append((i, j))
    return linked


@pytest.mark.parametrize(("bucket", "hashes"), [(1024, 2), (3, 2), (64, 3)])
def test_vector_links(spark, bucket, hashes):
    df, rows = clusters(spark)
    linked = links_by_hand(rows)
    n, root = Counter(x for p in linked for x in p), roots_of(range(len(rows)), linked)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df, bucket_size=bucket, hashes=hashes, tables=vectors.TABLES[hashes]).collect()}
    assert got == {i: (n[i], root[i], root[i] == i) for i in range(len(rows))}
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vectors_with_null_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    x, y, z = rng.normal(size=(3, 16))
    near = lambda v: (v + 0.01 * rng.normal(size=16)).tolist()
    rows = [(1, x.tolist()), (1, y.tolist()), (2, near(x)), (None, near(z)), (None, near(z)), (5, None), (None, near(y)), (6, x.tolist()), (None, [0.0])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, component_id string")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect())
    assert got == Counter([(1, 2, 1, True), (2, 2, 1, False), (6, 2, 1, False), (1, 1, 1, True), (None, 1, 1, False), (None, 1, None, False), (None, 1, None, False), (5, 0, 5, True), (None, 0, None, False)])
    with pytest.raises(ValueError):
        vectors.near_duplicates(df, tables=4)


@pytest.mark.parametrize(("vectors_", "dim", "least"), [(500, 64, 0.997), (50_000, 64, 0.997), (10_000_000, 64, 0.997), (50_000, 384, 0.997)])
def test_recall_at_the_threshold(vectors_, dim, least):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    tables, hashes = vectors.plan(vectors_, dim)
    a, b = (vectors.buckets(v, tables, hashes) for v in (x, 0.9 * x + math.sqrt(1 - 0.81) * z))
    assert np.mean([np.intersect1d(p, q).size > 0 for p, q in zip(a, b, strict=True)]) > least


def test_more_vectors_take_more_hashes():
    assert vectors.plan(500, 64) == (8, 2)
    assert vectors.plan(50_000, 64) == (12, 3)
    assert vectors.plan(10_000_000, 64) == (20, 4)
    assert vectors.plan(0, 1) == (8, 2)
    assert vectors.plan(50_000, 384) == (20, 2)


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(rng.normal(size=16) * rng.exponential(1)).round(2).tolist() for _ in range(600)]
    rows[50:60] = [rows[50]] * 10
    rows += [None, [1.0, None], [float("nan")] * 16, [3.0], [0.0] * 16]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, rank int")
    whole = {i: [math.floor(256 * x) for x in v] + [0] * (16 - len(v)) for i, v in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for i, q in whole.items():
        if i % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in whole.items() if j != i))[:5]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, block=64, query_block=5)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = df.where("vec_id in (0, 1, 2)")
    assert [r.rank for r in topk.top_k(few, F.col("vec_id") % 50 == 0).collect()] == [1, 2]


# -- language model


def scores_by_hand(rows, training, backoff):
    tokens = [[*words_of(t), "\n"] for _, t in rows]
    counts = [Counter() for _ in range(len(backoff) + 1)]
    for x, use in zip(tokens, training, strict=True):
        if use:
            x = ["\n", *x]
            for j in range(1, len(x)):
                for n in range(1, len(backoff) + 2):
                    if j - n + 1 >= 0:
                        counts[n - 1][tuple(x[j - n + 1 : j + 1])] += 1
    total, kinds = sum(counts[0].values()), len(counts[0])
    n1, n2 = (sum(v == k for v in counts[0].values()) for k in (1, 2))
    d = n1 / (n1 + 2 * max(n2, 1)) if n1 else 0.5
    out = []
    for x in tokens:
        x, score, base, known = ["\n", *x], 0.0, 0.0, 0
        for j in range(1, len(x)):
            c = counts[0][(x[j],)]
            known += c > 0
            if total:
                base += math.log10((c + 1) / (total + kinds + 1))
                p = (c - d) / total if c else d * kinds / total
                for n, m in enumerate(backoff, 2):
                    if j - n + 1 >= 0 and (h := counts[n - 2][tuple(x[j - n + 1 : j])]):
                        p = (counts[n - 1][tuple(x[j - n + 1 : j + 1])] + m * p) / (h + m)
                score += math.log10(p)
        out.append((len(x) - 1, known, total, base, score))
    return out


@pytest.mark.parametrize("backoff", [(500.0,), (20.0, 5.0, 2.0)])
def test_language_model(spark, backoff):
    rows = [(i, prose(int(n), i, 40)) for i, n in enumerate(np.random.default_rng(1).integers(0, 200, 40))]
    rows += [(40, None), (41, ""), (42, "Never SEEN words"), (43, prose(60, 3, 40)), (43, prose(60, 3, 40))]
    held = [i % 7 == 2 or i == 42 for i, _ in rows]
    df = docs_of(spark, rows)
    got = language_model.score_documents(df, ~((F.col("doc_id") % 7 == 2) | (F.col("doc_id") == 42)), backoff, block_bytes=2000).collect()
    want = sorted((i, *s) for (i, _), s in zip(rows, scores_by_hand(rows, [not h for h in held], backoff), strict=True))
    mine = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert [m[:4] for m in mine] == [w[:4] for w in want]
    assert np.allclose([m[4:] for m in mine], [w[4:] for w in want])


def test_each_states_probabilities_sum_to_one():
    texts = [b"a b a c", b"a b b", b"c a b a"]
    probe = [b"a " + w for w in (b"a", b"b", b"c", b"zzz")] + [b"a"]
    block = language_model.Block([*texts, *probe], np.array([1] * 3 + [0] * 5), 2)
    own = block.own[0]
    stats = (int(own.sum()), int((own > 0).sum()), int((own == 1).sum()), int((own == 2).sum()))
    machine = language_model.Automaton(block, block.own, stats, (2.0,))
    after_a = []  # each word, the unknown one and the end, after "a"
    for i in block.first[3:].tolist():
        machine.start = int(machine.after[1][0])  # the state of "a": the first text's first arc leads there
        after_a.append(10 ** machine.score(i + 1, i + 2))
    assert machine.start and abs(sum(after_a) - 1) < 1e-9


def test_states_and_failure_arcs():
    """The automaton itself, by hand: a trigram model of one text, "a b a b"; the other, "b b", is not trained on."""
    block = language_model.Block([b"a b a b", b"b b"], np.array([1, 0]), 3)
    own = block.own[0]
    machine = language_model.Automaton(block, block.own, (int(own.sum()), 3, int((own == 1).sum()), int((own == 2).sum())), (2.0, 1.0))
    a, b, end = (1 + block.place[0][i] for i in (0, 1, 4))
    assert machine.start == end and [machine.size[s] for s in (0, a, b, end)] == [0, 1, 1, 1]
    ab = machine.after[1][1]  # the arc of "b" from the state (a)
    assert machine.size[ab] == 2 and machine.fail[ab] == b and machine.fail[b] == 0  # (a b) fails to (b), (b) to the root
    assert machine.after[2][2] == machine.after[1][2]  # "a" leads from (a b), as from (b), to (b a)
    assert machine.after[1][6] == -1 and machine.after[0][6] == b  # "b b" was not seen: by the failure arc only
    assert machine.penalty[b] == pytest.approx(math.log10(2 / (2 + 2))) and machine.penalty[ab] == pytest.approx(math.log10(1 / (2 + 1)))
    # from the start no arc: end -> root -b-> (b), then (b) -> root -b-> (b), then (b) has the end
    by_hand = machine.penalty[end] + machine.step[0][5] + machine.penalty[b] + machine.step[0][6] + machine.step[1][7]
    assert machine.score(5, 8) == pytest.approx(by_hand)


def test_words_seen_once_only_keep_a_probability(spark):
    """No word occurs twice, so no estimate of the discount is below 1 by itself."""
    df = docs_of(spark, [(1, "a b c d e"), (2, "e a")])
    got = {r.doc_id: r for r in language_model.score_documents(df, F.col("doc_id") == 1).collect()}
    want = scores_by_hand([(1, "a b c d e"), (2, "e a")], [True, False], (500.0,))
    assert all(math.isfinite(got[i].score) and got[i].score == pytest.approx(w[4]) for i, w in zip((1, 2), want, strict=True))


def test_many_equal_texts_and_very_long_ones(spark, monkeypatch):
    monkeypatch.setattr(language_model, "COPIES", 3)
    rows = [(7, "same text here")] * 10 + [(None, "no id")] * 5 + [(None, "other")] + [(1, "w " * 60_000 + "x" * 100_000), (2, "a b"), (2, "a b"), (2, None), (2, None)]
    training = [i != 2 for i, _ in rows]
    got = language_model.score_documents(docs_of(spark, rows), F.coalesce(F.col("doc_id") != 2, F.lit(True))).collect()
    want = [(i, *s) for (i, _), s in zip(rows, scores_by_hand(rows, training, (500.0,)), strict=True)]
    order = lambda r: (str(r[0]), *r[1:3], round(r[5], 6))
    mine = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=order)
    assert len(mine) == len(rows) and all(m[:4] == w[:4] and np.allclose(m[4:], w[4:]) for m, w in zip(mine, sorted(want, key=order), strict=True))


def test_no_training_and_empty(spark):
    df = docs_of(spark, [(1, "a b"), (2, None)])
    got = language_model.score_documents(df, F.lit(False)).collect()
    assert [(r.n_known, r.train_tokens, r.score, r.base_score) for r in got] == [(0, 0, 0.0, 0.0)] * 2
    assert language_model.score_documents(df.limit(0), F.lit(True)).count() == 0


def test_packed_hashes_come_back():
    for n in (1, 2, 5000):
        h = np.unique(np.random.default_rng(n).integers(0, 1 << 64, n, dtype=np.uint64))
        assert (language_model.unpacked(language_model.packed(h)) == h).all()
    assert language_model.large(language_model.small(np.array([0, 255]))).tolist() == [0, 255]
    assert language_model.large(language_model.small(np.array([7, 256]))).tolist() == [7, 256]


# -- token counts


def test_ledger(spark, tmp_path):
    rows = [("a", "en", "t@1", 5, 1), ("a", None, "t@1", 7, 1), ("b", "en", "t@1", 0, 1)]
    schema = "source string, lang string, tokenizer string, tokens long, sign int"
    ledger = token_counts.Ledger(spark, str(tmp_path / "l"))
    assert ledger.totals().count() == 0
    first = spark.createDataFrame(rows, schema)
    assert ledger.commit("one", first) and not ledger.commit("one", first)
    assert sorted(map(str, ledger.totals().collect())) == sorted(map(str, spark.createDataFrame([("a", "en", "t@1", 1, 5), ("a", None, "t@1", 1, 7), ("b", "en", "t@1", 1, 0)], "source string, lang string, tokenizer string, docs long, tokens long").collect()))
    ledger.compact()
    assert not ledger.commit("one", first)
    assert ledger.commit("two", spark.createDataFrame([("a", "en", "t@1", 5, -1), ("a", "en", "t@1", 9, 1), ("b", "en", "t@1", 0, -1)], schema))
    assert ledger.commit("none", first.limit(0))
    assert sorted((r.source, r.lang, r.docs, r.tokens) for r in ledger.totals().collect() if r.lang) == [("a", "en", 1, 9)]
    # a batch that broke off has no marker and does not count
    (tmp_path / "l" / "batches" / "two" / "_SUCCESS").unlink()
    assert sorted((r.source, r.tokens) for r in ledger.totals().collect() if r.lang) == [("a", 5), ("b", 0)]
    ledger.compact()
    assert "two" not in ledger.committed()


def test_counts_by_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    Scratch(spark, "t")
    got = {(r.doc_id, r.tokenizer): r.tokens for r in token_counts.counted(docs_of(spark, [(1, "Hello  naïve\tworld"), (2, None), (3, "")]), {**token_counts.NATIVE, "bpe@1": path}).collect()}
    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode("Hello  naïve\tworld").ids
    assert got == {(1, "words@1"): 3, (1, "bytes@1"): 19, (1, "bpe@1"): len(ids)} | {(i, t): 0 for i in (2, 3) for t in ("words@1", "bytes@1", "bpe@1")}


def test_totals_by_brute_force(spark, sf):
    """The query's totals after its inserts, deletes, replays and revisions: the plain versions by SQL, the others by the libraries."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    got = sorted((str((r.source, r.lang, r.tokenizer)), r.docs, r.tokens) for r in token_counts.op3_token_counts(spark, sf).collect())
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = [(str((s, lang, t)), n, k) for s, lang, t, n, k in c.sql(token_counts.NATIVE_SQL).fetchall()]
    whole = {
        "byte_bpe_50k@1": lambda t, k=Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")): len(k.encode(t, add_special_tokens=False).ids),
        "piece_bpe_32k@1": lambda t, k=sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")): len(k.encode(t)),
    }
    docs, sums = Counter(), Counter()
    for source, lang, text in c.sql("select source, lang, text from documents").fetchall():
        for name, count in whole.items():
            docs[source, lang, name] += 1
            sums[source, lang, name] += count(text or "")
    assert got == sorted(want + [(str(k), n, sums[k]) for k, n in docs.items()])


def test_counts_of_odd_tables(spark):
    """Nulls, repeated rows and clashing columns, with a plain version and a vocabulary."""
    import public_tokenizers

    Scratch(spark, "t")
    rows = [(1, "a b", "s", "en", 1, 2), (1, "a b", "s", "en", 1, 2), (None, None, None, None, 1, 2), (2, " " * 200_000, "s", None, 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, tokens int, tokenizer int")
    counts = token_counts.counted(df, {"words@1": token_counts.NATIVE["words@1"], "bpe@1": public_tokenizers.path("byte_bpe_50k.tiktoken")})
    got = Counter((r.doc_id, r.tokenizer, r.tokens) for r in counts.collect())
    assert got == Counter([(1, "words@1", 2)] * 2 + [(1, "bpe@1", 2)] * 2 + [(None, "words@1", 0), (None, "bpe@1", 0), (2, "words@1", 0), (2, "bpe@1", 200_000)])
    assert token_counts.counted(df.limit(0), token_counts.VERSIONS).count() == 0


# -- queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_agree_with_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    want = c.sql(queries.ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    order = [want.columns.index(x) for x in cols]
    assert sorted(map(str, (tuple(r) for r in df.select(*cols).collect()))) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


COLUMNS = {
    "op1": ["vec_id", "n_links", "component_id", "kept"],
    "op4": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op5": ["query_id", "rank", "vec_id", "score"],
    "op6": ["doc_id", "size", "source_size", "target", "taken"],
    "op7": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op8": ["doc_id", "held_out", "score", "predicted"],
    "op9": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op10": ["doc_id", "fingerprint", "component_id"],
}


@pytest.mark.parametrize("op", sorted(COLUMNS))
def test_contract_columns(spark, sf, op):
    name = next(q for q in queries.QUERIES if q.startswith(op + "_"))
    df = queries.QUERIES[name](spark, sf)
    assert df.columns[: len(COLUMNS[op])] == COLUMNS[op]
    if "doc_id" in df.columns and op != "op9":
        ids = [r.doc_id for r in df.select("doc_id").collect()]
        assert sorted(ids) == sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())


def test_one_query_for_each_operator():
    assert [sum(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(1, 11)] == [1] * 10


def test_simhash_query_groups(spark, sf):
    got = queries.QUERIES["op10_simhash"](spark, sf).collect()
    by = defaultdict(set)
    for r in got:
        assert re.fullmatch("[0-9a-f]{16}", r.fingerprint)
        by[r.fingerprint].add(r.component_id)
    assert all(len(v) == 1 for v in by.values())
