"""Each stage against a plain version, on rows with planted cases and on the smallest tables."""

import re
import numpy as np

import corpus_pipeline as cp
from stratavec.llm import decontamination as dc
from tests.llm.test_line_dedup import brute as lines_brute

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], SCHEMA)


def test_stages_keep_columns_and_hand_on(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    before = docs.count()
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, D)
        assert docs.columns == list(cp.COLUMNS)
        rows = docs.collect()
        assert 0 < len(rows) <= before
        before = len(rows)
    pieces = cp.STAGES[-1][1](spark, docs, D).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in rows}
    assert sorted((p.doc_id, p.start, p.length) for p in pieces) == sorted((p.doc_id, p.start, p.length) for p in cp.run(spark, D).collect())


def test_language_stage(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    odd = frame(spark, [(10_001, None), (10_002, ""), (10_003, "12 34"), (10_004, "これは日本語の文章です")])
    kept = {r.doc_id for r in cp.identify_language(spark, docs.union(odd), D).collect()}
    assert kept == {r.doc_id for r in docs.collect()}


def test_line_stage(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r for r in cp.drop_shared_lines(spark, docs, D).collect()}
    for d, text, _, dropped in lines_brute(rows):
        assert got[d].text == text and (not dropped or got[d].n_chars == len(text))
    assert {r.lang for r in got.values()} == {r.lang for r in docs.collect()}


def test_near_duplicate_stage(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(9000, docs.first().text), (9001, None), (9002, "")]

    def shingle(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, lost = [(d, shingle(t)) for d, t in rows], set()
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 10 * len(x & y) >= 8 * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    lost = {d for d, _ in sets if find(d) != d}
    got = {r.doc_id for r in cp.drop_near_duplicates(spark, frame(spark, rows), D).collect()}
    assert got == {d for d, _ in rows} - lost and 9000 in lost
    twice = frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "a b c d e f")])
    assert sorted(str(r.doc_id) for r in cp.drop_near_duplicates(spark, twice, D).collect()) == ["1", "None", "None"]


def test_leak_stage(spark):
    items = [r.text for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(9000, f"before {items[0]} after"), (9001, items[1].upper()), (9002, " ".join(items[2].split()[:4]))]
    passages = [dc.words(t) for t in items]

    def leaks(t):
        w = b" " + b" ".join(dc.words(t)) + b" "
        return any(b" " + b" ".join(p) + b" " in w for p in passages)

    kept = {r.doc_id for r in cp.drop_benchmark_leaks(spark, frame(spark, rows), D).collect()}
    assert not any(leaks(t) for d, t in rows if d in kept) and {9000, 9001}.isdisjoint(kept) and 9002 in kept
    gone = [t for d, t in rows if d not in kept]
    assert np.mean([leaks(t) for t in gone]) > 0.5


def test_empty(spark):
    docs = frame(spark, [(1, "a")]).limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, docs, D)
        assert out.count() == 0


def test_workers_give_free_memory_back():
    from stratavec.llm.common import lean

    def held():
        return int(re.findall(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read())[0]) / 1024

    pins = []

    def run(batches):
        blocks = []
        for k in range(30_000):
            blocks.append(b"x" * 4000)
            if not k % 1000:
                pins.append(b"y" * 4000)
        yield from batches

    before = held()
    assert list(lean(run)([1, 2])) == [1, 2]
    assert held() - before < 40


def test_the_library_s_tokenizer_is_loaded_only_when_needed(monkeypatch):
    import tokenizers

    from stratavec.llm import packing

    class Refused:
        @staticmethod
        def from_file(path):
            raise AssertionError("loaded")

    want = packing.encoder(packing.tokenizer_path())("Some plain text.")
    packing.encoder.cache_clear()
    monkeypatch.setattr(tokenizers, "Tokenizer", Refused)
    try:
        assert packing.encoder(packing.tokenizer_path())("Some plain text.") == want
    finally:
        packing.encoder.cache_clear()
