"""Packing of documents into fixed windows by multiway differencing (Karmarkar and Karp).

A document is its token ids and one end id. Whole windows are cut off its front and fill a sequence each;
what remains is cut into pieces of at most PIECE ids. A group of pieces is one number-partitioning problem:
how to spread it over k windows evenly. Differencing keeps partial partitions, k sums each, and always
merges the two with the largest spread so that the large sums of one meet the small sums of the other. When
the fullest of the k windows exceeds the capacity, k rises and the group is partitioned anew.

Everything happens where a document is read: no shuffle, memory bounded by one batch of texts and one group.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from stratavec.llm.common import lean, release, texts

CAPACITY = 2048
PIECE = 512
GROUP = 2048
END_ID = 1

SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_tokens", pa.int64())])


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indexes of sizes in at most k nearly equal parts.

    A partial partition lists its non-empty parts, largest first; the k - len others are empty. Merging puts
    the other's parts, largest first, on this one's parts from the emptiest on.
    """
    heap = [(-size, i, [(size, (i,))]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    label = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        empty = k - len(a)
        merged = a + b[:empty]
        for at, (size, items) in zip(range(len(a) - 1, -1, -1), b[empty:]):
            merged[at] = (merged[at][0] + size, merged[at][1] + items)
        merged.sort(key=lambda part: -part[0])
        label += 1
        heapq.heappush(heap, ((merged[-1][0] if len(merged) == k else 0) - merged[0][0], label, merged))
    return [list(items) for _, items in heap[0][2]] if heap else []


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """The parts of :func:`differencing` for the first k, from the fewest possible on, that fits."""
    total = sum(sizes)
    k = -(-total // capacity)
    while True:
        parts = differencing(sizes, k)
        over = sum(max(0, sum(sizes[i] for i in p) - capacity) for p in parts)
        if not over:
            return parts
        k += max(1, over // capacity)


def _bytes_of(token: str, table: dict[str, int]) -> bytes:
    return bytes(table[c] for c in token)


@lru_cache(1)
def encoder(path: str):
    """text -> ids by the vocabulary file, as the tokenizers library gives them without special tokens added.

    The file's merges are ranked by id, so the ids are the library's (tests compare them); the rank encoder needs a
    third of its time and the library's own is only loaded when needed. Texts of the file's special tokens have these tokens' ids, as in the library; it takes over
    for a text that the rank encoder can't do.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer, pre_tokenizers

    file = json.load(open(path, encoding="utf-8"))
    vocabulary, added = file["model"]["vocab"], file["added_tokens"]
    special = {t["content"]: t["id"] for t in added}
    cut_plainly = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
    shown = sorted(pre_tokenizers.ByteLevel.alphabet())
    plain = [c for c in shown if ord(c) < 256]
    table = {c: ord(c) for c in plain}
    rest = sorted(set(range(256)) - set(table.values()))
    table |= dict(zip(sorted(set(shown) - set(plain)), rest))
    ranks = {_bytes_of(t, table): i for t, i in vocabulary.items() if t not in special and all(c in table for c in t)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    slow = lru_cache(1)(lambda: Tokenizer.from_file(path))

    def encode(text: str) -> list[int]:
        try:
            if not any(t in text for t in special):
                return fast.encode_ordinary(text)
            if cut_plainly:
                return fast.encode(text, allowed_special="all")
        except (KeyboardInterrupt, SystemExit, MemoryError):
            raise
        except BaseException:  # the extension reports its limits (very long runs) as a panic
            pass
        return slow().encode(text, add_special_tokens=False).ids

    del file, vocabulary, ranks
    release()
    return encode


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, piece: int = PIECE, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document: its place in the document and in a sequence.

    Columns: doc_id, start, length, ids_crc32 (of the little-endian 32-bit ids), doc_tokens, sequence_id,
    offset, sequence_tokens (ids in the sequence, before padding) and, if asked for, ids. A null or empty text
    is its end id alone. Repeated rows are packed each; a null doc_id stays null. Sequences hold at most
    ``capacity`` ids of documents of one partition; sequence_id is unique, not dense.
    """
    schema = SCHEMA.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or tokenizer_path())
        base, count, waiting, out = TaskContext.get().partitionId() << 32, 0, [], []

        def place(pieces: list[tuple], parts: list[list[int]]) -> None:
            nonlocal count
            for part in parts:
                offset, total = 0, sum(pieces[i][2] for i in part)
                for i in part:
                    head = pieces[i]
                    out.append((*head[:5], base + count, offset, total, *head[5:]))
                    offset += head[2]
                count += 1

        def full() -> pa.RecordBatch:
            ready = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return ready

        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.array([*encode(text or ""), END_ID], "<u4")
                n, start = len(ids), 0
                while start < n:
                    length = capacity if n - start >= capacity else min(piece, n - start)
                    own = ids[start : start + length]
                    row = (doc, start, length, zlib.crc32(own.tobytes()), n, *([own.astype(np.int32)] if with_ids else []))
                    if length == capacity:
                        place([row], [[0]])
                    else:
                        waiting.append(row)
                    start += length
                while len(waiting) >= group:
                    now, waiting = waiting[:group], waiting[group:]
                    place(now, windows([p[2] for p in now], capacity))
                if len(out) >= 8192:
                    yield full()
        if waiting:
            place(waiting, windows([p[2] for p in waiting], capacity))
        if out:
            yield full()

    ddl = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_tokens bigint"
    return texts(docs).mapInArrow(lean(run), ddl + (", ids array<int>" if with_ids else ""))
