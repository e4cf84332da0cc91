from collections import defaultdict

import numpy as np
import pytest

from stratavec.llm import line_dedup as ld
from stratavec.llm.common import texts


def brute(rows):
    docs = defaultdict(set)
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\v\f\r"))
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20 and d is not None:
                docs[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or not (len(docs[key(x)]) >= 3 and d != max(docs[key(x)]))]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


LONG = "A line that is long enough to count"
ROWS = [(1, f"{LONG}\nown\n\n  {LONG.upper()} \r\nend"), (2, LONG), (3, f"x\n{LONG}\n{LONG}"), (3, f"x\n{LONG}\n{LONG}"), (4, None), (5, ""), (6, "é" * 20), (7, "é" * 20 + "\t"), (8, "é" * 20), (9, "é" * 19), (10, "é" * 19),
        (11, "é" * 19), (None, LONG), (12, "two docs only, which is not enough"), (13, "two docs only, which is not enough"), (14, "word " * 40000)]


def result(df):
    return sorted(((r.doc_id, r.text or "", r.n_lines, r.n_dropped) for r in df.collect()), key=str)


@pytest.mark.parametrize("few", [0.0, 1.0])
def test_brute(spark, monkeypatch, few):
    """With all texts in the last join, and with those of documents that lose lines."""
    monkeypatch.setattr(ld, "FEW", few)
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in ROWS], "doc_id bigint, text string, keys int, h1 string").repartition(4)
    assert result(ld.line_dedup(docs).drop("rest")) == brute(ROWS)


def test_empty(spark):
    assert ld.line_dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_filter_has_no_false_negatives(spark):
    rows = [(d, f"this shared line has number {d % 700}") for d in range(1000)]
    bits = ld.repeated_filter(texts(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)))
    keys = [ld.line_hashes([t.encode()], 20)[0] for _, t in rows]
    found = ld.suspected(bits, np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2))
    assert found[:300].all() and not found[300:700].any()


def test_full_filter_keeps_results(spark, monkeypatch):
    """A filter that says yes to all only costs time."""
    monkeypatch.setattr(ld, "repeated_filter", lambda docs, least: np.full((ld.SHARDS, 1 << 11), 255, np.uint8))
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    assert result(ld.line_dedup(docs).drop("rest")) == brute(ROWS)


@pytest.mark.parametrize("size", [14, 17, 24])
def test_filters_of_every_size(spark, monkeypatch, size):
    monkeypatch.setattr(ld, "shard_bits", lambda docs: size)
    rows = [(d, f"this shared line has number {d % 700}") for d in range(1000)]
    bits = ld.repeated_filter(texts(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)))
    keys = np.frombuffer(b"".join(ld.line_hashes([t.encode()], 20)[0] for _, t in rows), np.uint64).reshape(-1, 2)
    assert bits.shape == (64, 1 << (size - 3)) and ld.suspected(bits, keys)[:300].all()


def test_filter_grows_with_the_lines(spark):
    sizes = [ld.shard_bits(texts(spark.range(1).selectExpr("id as doc_id", f"repeat('x\\n', {n}) as text"))) for n in (0, 10**4, 10**6, 10**7)]
    assert sizes == [14, 14, 17, 21]
