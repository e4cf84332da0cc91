import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratavec.llm import packing

TEXTS = [(1, "Hello world  it's 42!\n\n"), (2, None), (3, ""), (4, "é" * 9000 + " <|endoftext|> \u0000 日本語"), (8, "a <|endoftext|> b<|endoftext|><|endoftext|>c <|endoftext"), (9, "<|endoftext|>"), (5, "the cat " * 3000), (5, "the cat " * 3000), (None, "x"), (7, " " * 5000 + "a" * 5000)]


@given(st.lists(st.integers(1, 512), max_size=60))
def test_windows(sizes):
    parts = packing.windows(sizes, 2048)
    assert sorted(i for p in parts for i in p) == list(range(len(sizes)))
    assert all(0 < sum(sizes[i] for i in p) <= 2048 for p in parts)


def test_differencing_is_even():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 512, 1000).tolist()
    sums = [sum(sizes[i] for i in p) for p in packing.differencing(sizes, 130)]
    assert len(sums) == 130 and max(sums) - min(sums) < 100


def test_pack(spark):
    path = packing.tokenizer_path()
    tok = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(d, t, "x") for d, t in TEXTS], "doc_id bigint, text string, length string").repartition(2)
    rows = packing.pack(docs, path, with_ids=True).collect()
    want = {d: tok.encode(t or "", add_special_tokens=False).ids + [1] for d, t in TEXTS}
    got = {}
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        got.setdefault(r.doc_id, []).append((r.start, r.ids))
    for d, pieces in got.items():
        copies = 2 if d == 5 else 1
        ids = [i for _, p in sorted(pieces)[::copies] for i in p]
        assert ids == want[d]
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_tokens))
    for pieces in by.values():
        end = 0
        for offset, length, total in sorted(pieces):
            assert offset == end
            end += length
        assert end == total <= 2048


def test_ids_of_a_whole_table(spark):
    """Every document's ids are the library's, without any flag; with special tokens' texts put in here and there."""
    path = packing.tokenizer_path()
    tok = Tokenizer.from_file(path)
    encode = packing.encoder(path)
    for k, r in enumerate(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()):
        text = (r.text or "") if k % 3 else f"{(r.text or '')[:50]}<|endoftext|>{(r.text or '')[50:]} <|endoftext|>"
        assert encode(text) == tok.encode(text, add_special_tokens=False).ids


def test_padding(spark):
    rows = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    sequences = {r.sequence_id: r.sequence_tokens for r in rows}
    assert sum(2048 - n for n in sequences.values()) < 0.02 * sum(sequences.values())


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_small(spark, rows):
    assert packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string")).count() == len(rows)
