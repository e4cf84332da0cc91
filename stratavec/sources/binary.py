"""Raw binary vectors: a Python data source that scans ranges of fixed-size elements, and a writer.

Elements are little-endian. Missing: int32 minimum (integer, logical), a NaN whose low word is 1954
(numeric, complex: either part NaN); raw bytes have none. Paths are on a file system that all executors
see; a URI with a scheme is opened by pyarrow.fs.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, EqualTo

from stratavec.functions import types as V
from stratavec.operators.vector import Vector

# Fixed values of the file format.
ELEMENT = {"integer": "<i4", "logical": "<i4", "numeric": "<f8", "complex": "<c16", "raw": "u1"}
NA_INT = -(2**31)
NA_LOW_WORD = 1954
NA_REAL_BITS = 0x7FF00000_000007A2

BATCH = 1 << 18
PARTITION_ELEMENTS = 1 << 20, 8 << 20  # least and most of a partition; between them, one for each core


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def element_count(path: str, kind: str) -> int:
    """Elements in the file, whose size must divide exactly."""
    where, at = _filesystem(path)
    info = where.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type != pafs.FileType.File:
        raise OSError(f"not a regular file: {path}")
    size = np.dtype(ELEMENT[kind]).itemsize
    if info.size % size:
        raise ValueError(f"{path}: {info.size} bytes are not a multiple of {size}")
    return info.size // size


def decode(kind: str, data: bytes) -> pa.Array:
    """Elements as an Arrow array with missing values as nulls."""
    x = np.frombuffer(data, ELEMENT[kind])
    if kind == "integer":
        return pa.array(x, pa.int32(), mask=x == NA_INT)
    if kind == "logical":
        return pa.array(x != 0, pa.bool_(), mask=x == NA_INT)
    if kind == "raw":
        return pa.array(x.astype(np.int16), pa.int16())
    if kind == "numeric":
        return pa.array(x, pa.float64(), mask=np.isnan(x) & ((x.view(np.uint64) & 0xFFFFFFFF) == NA_LOW_WORD), from_pandas=False)
    gone = pa.array(np.isnan(x.real) | np.isnan(x.imag))
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x.real)), pa.array(np.ascontiguousarray(x.imag))], ["re", "im"], mask=gone)


def encode(kind: str, values: pa.Array) -> np.ndarray:
    """The inverse of :func:`decode`."""
    missing = np.asarray(values.is_null())
    if kind in ("integer", "logical"):
        out = np.array(values.cast(pa.int32()).fill_null(0), dtype="<i4")
        out[missing] = NA_INT
        return out
    if kind == "raw":
        return np.array(values.fill_null(0), dtype="u1")
    if kind == "numeric":
        out = np.array(values.fill_null(0.0), dtype="<f8")
        out.view("<u8")[missing] = NA_REAL_BITS
        return out
    out = np.zeros(len(values), "<c16")
    for k, part in enumerate(("re", "im")):
        own = np.array(values.field(part).fill_null(0.0), dtype="<f8")
        own.view("<u8")[missing] = NA_REAL_BITS
        out.view("<f8")[k::2] = own
    return out


class Slice(InputPartition):
    """Elements start (0-based) to stop (exclusive)."""

    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class BinaryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options["kind"]
        self.step = int(options.get("elements_per_partition", PARTITION_ELEMENTS[1]))
        self.start, self.stop = int(options.get("start", 0)), int(options.get("stop", -1))

    def partitions(self):
        n = element_count(self.path, self.kind)
        stop = n if self.stop < 0 else min(n, self.stop)
        return [Slice(a, min(a + self.step, stop)) for a in range(self.start, stop, self.step)] or [Slice(0, 0)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        where, at = _filesystem(self.path)
        size = np.dtype(ELEMENT[self.kind]).itemsize
        with where.open_input_file(at) as f:
            f.seek(part.start * size)
            for a in range(part.start, part.stop, BATCH):
                b = min(a + BATCH, part.stop)
                data = f.read((b - a) * size)
                if len(data) != (b - a) * size:
                    raise OSError(f"{self.path}: short read at element {a}")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a + 1, b + 1)), decode(self.kind, data)], ["idx", "value"])


class FilteringBinaryReader(BinaryReader):
    """Takes comparisons of idx from the plan: only partitions of that range are made."""

    def pushFilters(self, filters):
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column != ("idx",) or not isinstance(value, int):
                yield f
                continue
            low = {GreaterThan: value, GreaterThanOrEqual: value - 1, EqualTo: value - 1}.get(type(f))
            high = {LessThan: value - 1, LessThanOrEqual: value, EqualTo: value}.get(type(f))
            if low is not None:
                self.start = max(self.start, low)
            if high is not None:
                high = max(high, 0)
                self.stop = high if self.stop < 0 else min(self.stop, high)
            if low is None and high is None:
                yield f


class VectorBinary(DataSource):
    """``spark.read.format("vecbin").option("path", p).option("kind", "integer")``"""

    @classmethod
    def name(cls) -> str:
        return "vecbin"

    def schema(self):
        return V.T.StructType([V.T.StructField("idx", V.T.LongType()), V.T.StructField("value", V.SPARK_TYPE[self.options["kind"]])])

    def reader(self, schema):
        return (FilteringBinaryReader if self.options.get("push") == "true" else BinaryReader)(dict(self.options))


def read(spark: SparkSession, path: str, kind: str, elements_per_partition: int | None = None) -> Vector:
    """The file as a vector, scanned lazily and in parallel; slices scan only their range."""
    kind = V.canonical(kind)
    if kind not in ELEMENT:
        raise V.VectorTypeError(f"{kind} vectors have no binary form")
    n = element_count(path, kind)
    if elements_per_partition is None:
        least, most = PARTITION_ELEMENTS
        elements_per_partition = min(most, max(least, -(-n // spark.sparkContext.defaultParallelism)))
    spark.dataSource.register(VectorBinary)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")

    def scan(start: int, stop: int):
        options = {"path": path, "kind": kind, "elements_per_partition": elements_per_partition, "start": start - 1, "stop": stop, "push": push}
        return spark.read.format("vecbin").options(**options).load()

    return Vector(scan(1, n), "value", kind, n, source=scan)


def read_matrix(spark: SparkSession, path: str, kind: str, rows: int, cols: int) -> Vector:
    """A column-major matrix over the file or a prefix of it."""
    v = read(spark, path, kind)
    if rows * cols > v.length:
        raise ValueError(f"{rows} x {cols} elements asked for, {path} has {v.length}")
    return Vector(v.source(1, rows * cols), "value", v.kind, rows * cols, dim=(rows, cols), source=v.source)


def store(path: str, v: Vector) -> int:
    """Writes the vector's elements to one file; returns their number.

    Every task writes its elements at their own offsets of a temporary file that exists at full size, so a
    task run twice writes the same bytes; the file gets its name when all are done. The folder must be
    shared by driver and executors (random writes need a POSIX file system).
    """
    if v.kind not in ELEMENT:
        raise V.VectorTypeError(f"{v.kind} vectors have no binary form")
    kind, size, n, part = v.kind, np.dtype(ELEMENT[v.kind]).itemsize, v.length, f"{path}.part"
    with open(part, "wb") as f:
        f.truncate(n * size)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        fd = os.open(part, os.O_WRONLY)
        try:
            for batch in batches:
                at, data = np.asarray(batch.column(0)), encode(kind, batch.column(1))
                order = np.argsort(at, kind="stable")
                at, data = at[order], data[order]
                cuts = np.flatnonzero(np.diff(at) != 1) + 1
                for run, first in zip(np.split(data, cuts), at[np.r_[0, cuts]] if len(at) else []):
                    os.pwrite(fd, run.tobytes(), (int(first) - 1) * size)
                done += len(at)
        finally:
            os.close(fd)
        yield pa.RecordBatch.from_arrays([pa.array([done])], ["n"])

    written = v.to_df().mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0
    if written != n:
        os.remove(part)
        raise OSError(f"{written} of {n} elements were written")
    os.replace(part, path)
    return n
