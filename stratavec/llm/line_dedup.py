"""Removal of lines that many documents share, found with two Bloom filters.

Every task fills two filters over its lines' keys: seen, and seen again. Filters of all tasks are folded, by
shards of the bit range: a bit that is set in two tasks' first filters is set in the second. Only keys whose
bits are all in the folded second filter can be in two documents; only those are shuffled, as 128-bit hashes,
to be counted exactly and to choose the document that keeps them. The filters have 8 bits or more for each line, up to
2^30 (what is broadcast is 128 MB then); beyond that they let more keys through to the exact count, and results stay.
Where few documents lose lines, a filter of their ids keeps all other texts out of the last join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.llm.common import discard, filter_place, id_filter, in_filter, lean, stored, texts

SHARDS = 64
LEAST_BITS, MOST_BITS = 14, 24  # bits of a shard as a power of two
FEW = 0.25  # share of documents that lose lines, up to which the others' texts stay out of the join
FILTERED = 1 << 26  # such documents that a broadcast filter can tell (16 bits each, so 128 MB)
FLUSH = 1 << 21  # keys that a task holds before it hands out a part of its filters
MIN_POINTS, MIN_DOCUMENTS = 20, 3


def key_of(line: bytes) -> bytes:
    """The line without white space at its ends and with A-Z lower-cased (what bytes methods do)."""
    return line.strip().lower()


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "surrogatepass")) >= least)


def line_hashes(lines: list[bytes], least: int) -> list[bytes | None]:
    """128-bit hash of each line's key; None for keys that are too short."""
    return [xxhash.xxh3_128_digest(k) if long_enough(k := key_of(x), least) else None for x in lines]


def lines_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def _numbers(digests: list[bytes]) -> np.ndarray:
    """Digests as an n x 2 array."""
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def shard_bits(docs: DataFrame) -> int:
    """Power of two of a shard's bits, by the number of lines."""
    lines = docs.agg(F.sum(F.size(F.split("text", "\n")).cast("bigint"))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, (8 * lines // SHARDS).bit_length()))


def _bits(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each key, and its three bits there."""
    a, b, low = h[:, 0], h[:, 1], np.uint64((1 << size) - 1)
    shard = (a >> np.uint64(58)).astype(np.int64) % SHARDS
    return shard, np.stack([a & low, (a >> np.uint64(size)) & low, b & low], 1).astype(np.int64)


def _filters(seen: list[np.ndarray], size: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Bit positions of both filters, by shard, from the keys of a task's documents."""
    keys, counts = np.unique(np.concatenate(seen), axis=0, return_counts=True)
    shard, bits = _bits(keys, size)
    for s in np.unique(shard):
        own = shard == s
        yield int(s), *(np.unique(bits[own & (counts >= n)]).astype("<u4").tobytes() for n in (1, 2))


def repeated_filter(docs: DataFrame, least: int = MIN_POINTS) -> np.ndarray:
    """The second filter over all documents, SHARDS rows of packed bits."""
    size = shard_bits(docs)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = [], 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*_filters(seen, size)))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["shard", "once", "twice"])

        for batch in batches:
            for text in batch.column(1).to_pylist():
                own = {h for h in line_hashes(lines_of(text), least) if h}
                if own:
                    seen.append(_numbers(list(own)))
                    held += len(own)
                if held >= FLUSH:
                    yield out()
                    seen, held = [], 0
        if seen:
            yield out()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = {}, {}
        for batch in batches:
            for s, one, two in zip(*(c.to_pylist() for c in batch.columns)):
                new = np.zeros(1 << size, bool)
                new[np.frombuffer(one, "<u4")] = True
                new = np.packbits(new)
                again = np.zeros(1 << size, bool)
                again[np.frombuffer(two, "<u4")] = True
                if s not in once:
                    once[s], twice[s] = np.zeros_like(new), np.zeros_like(new)
                twice[s] |= np.packbits(again) | (once[s] & new)
                once[s] |= new
        yield pa.RecordBatch.from_arrays([pa.array(list(twice), pa.int32()), pa.array([x.tobytes() for x in twice.values()], pa.binary())], ["shard", "bits"])

    parts = docs.where("doc_id is not null").mapInArrow(lean(fill), "shard int, once binary, twice binary")
    folded = parts.repartition(SHARDS, "shard").mapInArrow(lean(fold), "shard int, bits binary")
    out = np.zeros((SHARDS, (1 << size) // 8), np.uint8)
    for r in folded.collect():  # SHARDS rows of bounded size
        out[r["shard"]] = np.frombuffer(r["bits"], np.uint8)
    return out


def suspected(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which keys have all their bits in the filter."""
    shard, at = _bits(h, (8 * bits.shape[1]).bit_length() - 1)
    return ((bits[shard[:, None], at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)


def dropped_keys(docs: DataFrame, least: int = MIN_POINTS, documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The keys that each document loses, stored: doc_id and a list of 128-bit hashes, for documents that lose any."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(repeated_filter(docs, least))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = {h for h in line_hashes(lines_of(text), least) if h}
                if own and doc is not None:
                    h = _numbers(list(own))
                    h = h[suspected(shared.value, h)]
                    found.append(h)
                    ids.append(np.full(len(h), doc, np.int64))
            if found:
                h = np.concatenate(found).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], ["doc_id", "h1", "h2"])

    pairs = stored(docs.mapInArrow(lean(suspects), "doc_id bigint, h1 bigint, h2 bigint"), "line-suspects")
    counted = pairs.groupBy("h1", "h2").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
    confirmed = stored(counted.where(F.col("n") >= documents).select("h1", "h2", "keeper"), "line-confirmed")
    lost = pairs.join(confirmed, ["h1", "h2"]).where("doc_id <> keeper")
    key = F.struct("h1", "h2")
    out = stored(lost.groupBy("doc_id").agg(F.collect_set(key).alias("keys")), "line-lost")
    discard(pairs)
    discard(confirmed)
    return out


def line_dedup(docs: DataFrame, least: int = MIN_POINTS, documents: int = MIN_DOCUMENTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs without the lines that at least ``documents`` documents share, which the largest doc_id keeps.

    A line's key is stripped of ASCII white space and has A-Z lower-cased; keys under ``least`` code points
    never count. Returns doc_id, text (kept lines joined; null stays null), n_lines, n_dropped, and ``rest``, a struct of
    the columns to carry. A null or empty text is one empty line. Rows that repeat a doc_id count as one document
    and lose the same lines; rows without doc_id neither count nor lose any.
    """
    own = texts(docs)
    rest = F.struct(*[docs[c] for c in carry]) if carry else F.lit(None).cast("boolean")
    whole = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"), rest.alias("rest"))
    lost = dropped_keys(own, least, documents)
    n = lost.count()
    affected, untouched = whole, None
    if n <= min(FILTERED, FEW * own.count()):
        bits = max(20, (16 * n).bit_length())
        shared = docs.sparkSession.sparkContext.broadcast(id_filter(lost, bits))

        @F.arrow_udf("boolean")
        def told(h: pa.Array) -> pa.Array:  # only ids go to Python
            return pa.array(in_filter(shared.value, np.asarray(h)))

        loses = F.col("doc_id").isNotNull() & told(F.coalesce(filter_place(bits), F.lit(0)))
        affected = whole.where(loses)
        lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("bigint")
        untouched = whole.where(~loses).select("doc_id", "text", lines.alias("n_lines"), F.lit(0).cast("bigint").alias("n_dropped"), "rest")
    joined = affected.join(lost, "doc_id", "left").select("doc_id", "text", "keys", "rest")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, keys in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines = lines_of(text)
                n_lines.append(len(lines))
                left = lines
                if keys:
                    gone = {np.array([k["h1"], k["h2"]], np.int64).tobytes() for k in keys}
                    left = [x for x, h in zip(lines, line_hashes(lines, least)) if h not in gone]
                n_dropped.append(len(lines) - len(left))
                kept.append(text if len(left) == len(lines) else b"\n".join(left).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), batch.column(3)], ["doc_id", "text", "n_lines", "n_dropped", "rest"])

    out = joined.mapInArrow(lean(cut), f"doc_id bigint, text string, n_lines bigint, n_dropped bigint, rest {joined.schema['rest'].dataType.simpleString()}")
    return out if untouched is None else out.union(untouched)
