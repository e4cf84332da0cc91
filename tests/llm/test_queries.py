"""The registered queries: their columns against the contracts, and their SQL where they have one."""

import zlib

import pytest

from stratavec.llm import queries
from tests.compare import connect, differences

D = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op2_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op3_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op5_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op6_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op8_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
}
SPLIT = {"op1_lm_scoring": (7, 2), "op8_toxicity": (4, 2), "op9_language_id": (3, 1)}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    assert not differences(spark, connect(D), D, name, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, name):
    out = queries.QUERIES[name](spark, D)
    assert set(COLUMNS[name].split(", ")) <= {f"{c} {t}" for c, t in out.dtypes}
    rows = out.collect()
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", "lang").collect()
    if name in ("op5_topk",):
        vectors = {r.vec_id for r in spark.read.parquet(f"{D}/embeddings.parquet").collect()}
        assert {r.query_id for r in rows} == {v for v in vectors if v % 50 == 0} and all(r.vec_id != r.query_id and 1 <= r.rank <= 5 for r in rows)
        return
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs}
    if name == "op6_packing":
        by, sequences = {}, {}
        for r in rows:
            by.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for pieces in by.values():
            assert sorted(s + n for s, n, _ in pieces)[:-1] == sorted(s for s, _, _ in pieces)[1:] and max(s + n for s, n, _ in pieces) == pieces[0][2]
        assert all(sum(n for _, n in s) <= 2048 for s in sequences.values())
        return
    assert len(rows) == len(docs)
    if name in SPLIT:
        modulus, own = SPLIT[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == own) for r in rows)
    if name == "op8_toxicity":
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    if name == "op9_language_id":
        learned = {r.lang for r in docs if r.lang is not None} | {"und"}
        assert all(0 <= r.score <= 1 and r.lang_pred in learned for r in rows)
        assert all((r.lang_pred == "und") == (not any(map(str.isalpha, t[r.doc_id] or ""))) for t in [{d.doc_id: d.text for d in docs}] for r in rows)
    if name == "op1_lm_scoring":
        words = {d.doc_id: len((d.text or "").encode().split()) + 1 for d in docs}
        assert all(r.n_tokens == words[r.doc_id] and r.n_known <= r.n_tokens for r in rows)
        assert {r.train_tokens for r in rows} == {sum(words[r.doc_id] for r in rows if not r.held_out)}
    if name == "op3_jaccard_join":
        assert all(r.component_id <= r.doc_id for r in rows) and {r.component_id for r in rows} == {r.doc_id for r in rows if r.component_id == r.doc_id}


@pytest.mark.parametrize("name", ["op4_secrets", "op7_pii", "op10_decontamination"])
def test_others_run(spark, name):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0
