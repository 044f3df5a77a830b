import os
import shutil
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from loomlint.llm import packing, quality, simhash, substrings
from loomlint.llm._common import Scratch, Union

NAMES = ["quality classifier", "simhash near-dedup", "substring dedup", "mixing sources", "best-fit packing"]


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return bool(a) and len(a & b) >= 0.8 * len(a | b)


def one_of_each_by_hand(rows):
    """Of rows (doc_id, text) one for each component: fingerprints within 2 bits or similarity 0.8; the smallest doc_id, null last."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    fps, sets = [simhash.fingerprint(None if t is None else t.encode()) for _, t in rows], [grams(t) for _, t in rows]
    union = Union(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 or similar(sets[i], sets[j]):
                union.join(i, j)
    return [r for i, r in enumerate(rows) if union.find(i) == i]


def test_stages_hold_against_their_inputs(spark, sf):
    scratch = Scratch(spark, "t")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = scratch.keep(stage(spark, docs, sf), name.replace(" ", "-"))
        at[name] = (before.toPandas(), docs.toPandas())
        if name != NAMES[-1]:
            assert docs.columns == columns
    before, after = at["quality classifier"]
    model = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    x = np.array([quality.features(t.encode()) for t in before.text], np.float64)
    assert set(after.doc_id) == set(before.doc_id[model.score(x) >= 0.5])
    before, after = at["simhash near-dedup"]
    assert sorted(zip(after.doc_id, after.text, strict=True)) == sorted(one_of_each_by_hand(list(zip(before.doc_id, before.text, strict=True))))
    before, after = at["substring dedup"]
    assert sorted(after.doc_id) == sorted(before.doc_id)
    texts = dict(zip(before.doc_id, before.text, strict=True))
    spans = defaultdict(list)
    for r in substrings.repeated_spans(spark.createDataFrame(before[["doc_id", "text"]], "doc_id long, text string")).collect():
        spans[r.doc_id].append((r.start, r.size))
        whole = texts[r.doc_id].encode()[r.start : r.start + r.size]
        assert r.keep_doc_id < r.doc_id and len(whole.split()) >= 20 and r.words <= len(whole.split()) + 1
    assert all(t == substrings.without(texts[i].encode(), spans[i]).decode() for i, t in zip(after.doc_id, after.text, strict=True))
    left = substrings.repeated_spans(spark.createDataFrame(after[["doc_id", "text"]], "doc_id long, text string")).count()
    assert left <= 2
    before, after = at["mixing sources"]
    assert set(after.doc_id) <= set(before.doc_id)
    sizes = {i: len(t.split()) for i, t in zip(before.doc_id, before.text, strict=True)}
    taken = after.assign(n=after.text.map(lambda t: len(t.split()))).groupby("doc_id").n.sum()
    assert all(n <= 3 * sizes[i] for i, n in taken.items())
    before, after = at["best-fit packing"]
    assert (after.groupby("sequence_id").length.sum() <= 2048).all()
    encode = packing.encoder(packing.vocabulary())
    assert after.length.sum() == sum(len(encode(t)) + 1 for t in before.text)


def test_run_is_the_stages_in_turn(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES


def test_no_similar_texts_stay_after_near_dedup(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.near_dedup(spark, docs, sf).toPandas()
    sets = [grams(t) for t in kept.text.dropna()]
    assert not [1 for n, a in enumerate(sets) for b in sets[:n] if similar(a, b)]


def prose(n, seed):
    return " ".join(f"{chr(97 + int(x) % 26)}{int(x) * 7919 % 3001}" for x in np.random.default_rng(seed).integers(0, 3000, n))


P = prose(90, 1)
#: doc_id, text, lang, source; nulls in every column, repeated ids and rows, empty and long texts, ties.
ODD = [
    (1, f"{prose(60, 2)} {P}", "en", "a"),
    (2, prose(70, 3), "en", "b"),
    (2, prose(80, 4), "en", "b"),
    (2, prose(80, 4), "en", "b"),
    (None, prose(50, 5), "en", "a"),
    (None, f"{P} {prose(40, 6)}", None, None),
    (None, prose(50, 5), "en", "a"),
    (7, None, "en", "a"),
    (8, "", None, "b"),
    (9, " \n\t", "en", None),
    (10, "one", "en", "c"),
    (11, prose(9000, 7) + " " + "x" * 50_000, "en", "a"),
    (12, f"{prose(30, 8)} {P} {prose(30, 9)}", "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 0, 0), (10, None, 0), (11, 1, 0), (12, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 1, 2) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, _row int, start int")
    return docs, at


def rows_of(df):
    return Counter((r.doc_id, r.text, r.lang, r.source) for r in df.collect())


def test_odd_rows_in_the_quality_stage(spark, odd):
    docs, at = odd
    out = corpus_pipeline.quality(spark, docs, at)
    assert out.columns == docs.columns and not rows_of(out) - rows_of(docs)
    model = quality.train(docs, spark.read.parquet(f"{at}/labels.parquet"))
    score = lambda t: model.score(np.array([quality.features(None if t is None else t.encode())], np.float64))[0]
    assert rows_of(out) == Counter(r for r in ODD if score(r[1]) >= 0.5)


def test_odd_rows_in_the_near_dedup_stage(spark, odd):
    docs, at = odd
    out = corpus_pipeline.near_dedup(spark, docs, at)
    want = one_of_each_by_hand([(i, t) for i, t, _, _ in ODD])
    assert out.columns == docs.columns and sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, want))
    assert (2, ODD[1][1]) in want and (2, ODD[2][1]) in want  # two texts of one doc_id


def test_odd_rows_in_the_substring_stage(spark, odd):
    docs, at = odd
    out = corpus_pipeline.substring_dedup(spark, docs, at)
    got = rows_of(out)
    assert out.columns == docs.columns and sum(got.values()) == len(ODD)
    first = (1, ODD[0][1], "en", "a")
    assert got[first] == 1  # keeps the passage
    cut = [(i, t, s) for (i, t, _, s) in got if (i, s) in ((None, None), (12, "a"))]
    assert len(cut) == 2 and all(len((Counter(t.split()) & Counter(P.split()))) < 40 for _, t, _ in cut)
    untouched = Counter(r for r in ODD if P not in (r[1] or ""))
    assert not untouched - got
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and (r._row, r.start) == (1, 2) for r in out.collect())


def test_odd_rows_in_the_mixing_stage(spark, odd):
    """Every row in is accounted for: what each source takes is its target, and no row is taken more than 3 times."""
    docs, at = odd
    out = corpus_pipeline.mixing(spark, docs, at)
    from loomlint.llm.mixing import plan_sources

    sizes = Counter()
    for _, t, _, s in ODD:
        sizes[s] += len((t or "").split())
    taken, by_row = Counter(), Counter()
    for r in out.collect():
        n = len(r.text.split())
        taken[r.source] += n
        by_row[r.doc_id, r.source] += n
        assert r.n_chars == len(r.text) and (r._row, r.start) == (1, 2)
        assert any((i, s) == (r.doc_id, r.source) and not Counter(r.text.split()) - Counter((t or "").split()) for i, t, _, s in ODD)
    assert out.columns == docs.columns and taken == {s.name: round(s.target) for s in plan_sources(list(sizes.items()), block_words=1024) if s.slots}
    own = Counter()
    for i, t, _, s in ODD:
        own[i, s] += len((t or "").split())
    assert all(n <= 3 * own[k] for k, n in by_row.items())


def test_odd_rows_in_the_packing_stage(spark, odd):
    docs, at = odd
    encode = packing.encoder(packing.vocabulary())
    got = Counter()
    for r in corpus_pipeline.packing(spark, docs, at).collect():
        got[r.doc_id] += r.length
    want = Counter()
    for i, t, _, _ in ODD:
        want[i] += len(encode(t or "")) + 1
    assert got == want


def test_empty_tables_in_every_stage(spark, odd):
    docs, at = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), at)
        assert out.count() == 0 and (name == NAMES[-1] or out.columns == docs.columns)


KEEP = """
import sys
from pyspark.sql import SparkSession
from loomlint.llm._common import Scratch
spark = SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", sys.argv[1]).config("spark.ui.enabled", "false").getOrCreate()
for what in ("plain", "named"):
    kept = Scratch(spark, what).keep(spark.range(1000).repartition(20), "kept")
    assert sorted(r.id for r in kept.collect()) == list(range(1000)) and len(kept.inputFiles()) == 20
    spark.conf.set("fs.file.impl", "org.apache.hadoop.fs.LocalFileSystem")
"""


def test_scratch_tables_start_no_process_for_checksum_files(tmp_path):
    """A process that a JVM starts has the JVM's memory as its own for a moment; a session's own class for local files is used."""
    log, own = tmp_path / "log", tmp_path / "bin"
    own.mkdir()
    (own / "chmod").write_text(f'#!/bin/sh\necho "$@" >> {log}\nexec {shutil.which("chmod")} "$@"\n')
    (own / "chmod").chmod(0o755)
    env = os.environ | {"PATH": f"{own}:{os.environ['PATH']}"}
    subprocess.run([sys.executable, "-c", KEEP, str(tmp_path / "shared")], env=env, check=True, timeout=200, cwd=Path(__file__).resolve().parents[2])
    started, sums = log.read_text().splitlines() if log.exists() else [], list((tmp_path / "shared").rglob("*.crc"))
    plain, named = (sum(f"/{what}-" in x for x in started) for what in ("plain", "named"))
    assert plain <= named - 20 or not named  # none at all where Hadoop has its native libraries
    assert {x.parts[-3].split("-")[0] for x in sums} == {"named"}
