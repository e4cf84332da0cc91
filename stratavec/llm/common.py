"""What the operators share: tables, intermediate results in the cluster's shared folder, words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset on one machine (tests), a temporary one.

    On a cluster a machine's own folder would lose data, so there it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _temporary()


@lru_cache(1)
def _temporary() -> str:
    return f"file://{tempfile.mkdtemp(prefix='stratavec-')}"


#: With it, the shuffle files of a query go at the query's end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts the lineage, and survives lost executors.

    The written table stands for df from then on, so the shuffle files that made it are deleted at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        # a plan of its own: how a plan's shuffle files are cleaned is settled when it is made
        df.select("*").write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what :func:`stored` wrote; call it when nothing reads it any more."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only: other columns, whatever their names, stay out of the plan."""
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))


def remainder(modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus: the split between training and held-out rows."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def sampled(docs: DataFrame, most: int, total: int) -> DataFrame:
    """About ``most`` of ``total`` rows (all, if there are no more), chosen by a hash of doc_id."""
    if total <= most:
        return docs
    return docs.where(F.pmod(F.xxhash64("doc_id", F.lit(977)), F.lit(1 << 20)) < int((1 << 20) * most / total))


def filter_place(bits: int) -> Column:
    """A doc_id's bit in a filter of 2^bits bits."""
    return F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << bits)).alias("h")


def id_filter(ids: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of doc_ids with 2^bits bits (a power of 6 or more), one bit each; 64 tasks fill it."""
    shard = bits - 6

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            h = np.asarray(batch.column(0))
            for s in np.unique(h >> shard):
                own.setdefault(int(s), np.zeros(1 << shard, bool))[h[h >> shard == s] & ((1 << shard) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([np.packbits(b).tobytes() for b in own.values()], pa.binary())], ["shard", "bits"])

    rows = ids.select(filter_place(bits)).distinct().repartition(64, F.shiftright("h", shard)).mapInArrow(fold, "shard bigint, bits binary").collect()
    out = np.zeros((64, (1 << shard) // 8), np.uint8)
    for r in rows:
        out[r["shard"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def in_filter(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which places of :func:`filter_place` are set."""
    return (bits[h >> 3] >> (7 - (h & 7)).astype(np.uint8)) & 1 == 1


@lru_cache(1)
def _trim() -> Callable | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives memory that is free within this process back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def lean(run: Callable) -> Callable:
    """run for mapInArrow, whose worker gives its free memory back after each task.

    Spark keeps workers for later tasks; beside the JVM, what they keep counts against the executor's memory.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return own


class WordHashes(dict):
    """64-bit hash of each word, remembered for up to ``most`` words."""

    def __init__(self, most: int = 1 << 15):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def split_words(column: pa.Array, most: int) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, of slices of a text column of up to ``most`` bytes (or one text).

    Of each slice: its first row, its distinct words (possibly with an unused ""), each text's number of words, and all
    words as indexes.
    """
    column = pc.fill_null(column, "")
    size = np.cumsum(np.asarray(pc.binary_length(column), np.int64))
    first = 0
    while first < len(column):
        done = size[first - 1] if first else 0
        n = max(1, int(np.searchsorted(size, done + most, "right")) - first)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(column.slice(first, n)))
        flat = lists.flatten().dictionary_encode()
        distinct, index = flat.dictionary, np.asarray(flat.indices)
        owner = np.repeat(np.arange(n), np.asarray(lists.value_lengths()))
        empty = pc.index(distinct, "").as_py()  # what white space at a text's ends leaves behind
        if empty >= 0:
            owner, index = owner[index != empty], index[index != empty]
        yield first, distinct, np.bincount(owner, minlength=n), index
        first += n


def word_hashes(distinct: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a word-hash sequence; with fewer words, of it all."""
    if not len(h):
        return h
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
    return np.unique(out)
