"""User functions over vectors, in Arrow batches."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.functions import types as V
from stratavec.operators.vector import Vector, align


PROBED = 10_000  # elements of the first chunk that tell the result's type


def _kind_of(values) -> str:
    """The vector type of what a function returned; all missing is logical."""
    s = pd.Series(values)
    kind = {"b": "logical", "i": "integer", "u": "integer", "f": "numeric"}.get(s.dtype.kind)
    if kind is None:
        kinds = {type(v).__name__ for v in s if v is not None and v == v}
        kind = next((k for t, k in (("str", "character"), ("float", "numeric"), ("int", "integer"), ("bool", "logical")) if t in kinds), "character" if kinds else "logical")
    return kind


def apply(fun: Callable, *vectors: Vector, kind: str | None = None, more_args: dict | None = None, use_names: bool = True, chunk_size: int | None = None) -> Vector:
    """``fun(series_1, ..., series_k, **more_args)`` over aligned, recycled vectors.

    fun gets pandas Series and returns one of the same length. kind: result type; None asks fun with the start of
    the first chunk. use_names: names come from the first vector, or are its values where it is character.
    chunk_size: fun is called for positions 1 to chunk_size, then the next as many, and so on, in order, which deals
    the vectors out by chunk; without it, for Arrow batches as they are read, with no shuffle.
    """
    if not vectors:
        raise ValueError("apply needs a vector")
    more = more_args or {}
    frame, values, n = align(*vectors)
    if kind is None:
        first = frame.where(F.col("idx") <= min(chunk_size or PROBED, PROBED)).orderBy("idx")
        probe = first.select(*[v.alias(f"p{k}") for k, v in enumerate(values)]).toPandas()
        kind = _kind_of(fun(*[probe[c] for c in probe], **more)) if len(probe) else "logical"
    if chunk_size is not None:
        if chunk_size < 1:
            raise ValueError("chunk_size must be positive")
        own = frame.select("idx", *[v.alias(f"v{k}") for k, v in enumerate(values)])
        name = vectors[0].names if frame is vectors[0].frame else None
        if use_names and name is not None:
            own = frame.select("idx", *[v.alias(f"v{k}") for k, v in enumerate(values)], name.alias("name"))
        elif use_names and vectors[0].kind == "character":
            own = own.withColumn("name", F.col("v0"))
        named, width = "name" in own.columns, len(vectors)

        def one(chunk: pd.DataFrame) -> pd.DataFrame:
            chunk = chunk.sort_values("idx", ignore_index=True)
            out = pd.DataFrame({"idx": chunk["idx"], "value": pd.Series(fun(*[chunk[f"v{k}"] for k in range(width)], **more)).to_numpy()})
            return out.assign(name=chunk["name"]) if named else out

        schema = V.T.StructType([V.T.StructField("idx", V.T.LongType()), V.T.StructField("value", V.SPARK_TYPE[kind])] + ([V.T.StructField("name", V.T.StringType())] if named else []))
        done = own.groupBy(F.expr(f"(idx - 1) div {chunk_size}")).applyInPandas(one, schema)
        return Vector(done, "value", kind, n, F.col("name") if named else None)

    @F.pandas_udf(V.SPARK_TYPE[kind])
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series(fun(*series, **more))

    out = run(*values)
    names = vectors[0].names if use_names and frame is vectors[0].frame else None
    if use_names and vectors[0].kind == "character" and names is None:
        names = values[0]
    done = frame.select("idx", out.alias("value"), *([names.alias("name")] if names is not None else []))
    return Vector(done, "value", kind, n, F.col("name") if names is not None else None)


def chunk_bounds(x: Vector, number: int, size: int, total: int | None = None) -> tuple[int, int]:
    """First and last position of the number-th (from 1) chunk of x recycled to total elements."""
    total = x.length if total is None else total
    if number < 1 or (number - 1) * size >= total:
        raise IndexError(f"there is no chunk {number} of {size} in {total} elements")
    return (number - 1) * size + 1, min(number * size, total)


def chunk(x: Vector, number: int, size: int, total: int | None = None) -> DataFrame:
    """Elements of the number-th (from 1) chunk of x recycled to total elements: ``(idx, value)``.

    idx runs from the first to the last position of :func:`chunk_bounds`.
    """
    total = x.length if total is None else total
    start, stop = chunk_bounds(x, number, size, total)
    if total <= x.length:
        return x.to_df().where(F.col("idx").between(start, stop))
    wanted = x.frame.sparkSession.range(start, stop + 1).select(F.col("id").alias("idx"))
    placed = wanted.withColumn("__at", F.pmod(F.col("idx") - 1, F.lit(x.length)) + 1)
    return placed.join(x.to_df().withColumnRenamed("idx", "__at"), "__at").select("idx", "value")
