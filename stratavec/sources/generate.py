"""Sequences, constant vectors, columns of tables and user-defined generators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavec.functions import types as V
from stratavec.operators.vector import Vector

DEFAULTS = {"integer": 0, "numeric": 0.0, "logical": False, "character": ""}


def _positions(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").alias("idx"))


def sequence(spark: SparkSession, start: int, stop: int, by: int = 1, kind: str = "integer", strict: bool = False) -> Vector:
    """start, start + by, ... up to stop: ``trunc((stop - start) / by) + 1`` elements, by of either sign.

    Arguments are truncated to whole numbers. strict: require start < stop and by > 0.
    """
    start, stop, by = int(start), int(stop), int(by)
    if strict and (start >= stop or by <= 0):
        raise ValueError("a strict sequence needs start < stop and by > 0")
    if by == 0:
        raise ValueError("by must not be 0")
    n = int((stop - start) / by) + 1 if (stop - start) * by >= 0 else 0
    value = (F.lit(start).cast("bigint") + (F.col("idx") - 1) * F.lit(by)).cast(V.SPARK_TYPE[kind])
    return Vector(_positions(spark, n), value, kind, n, source=lambda a, b: spark.range(a, b + 1).select(F.col("id").alias("idx")))


def constant(spark: SparkSession, kind: str = "logical", length: int = 0, populate_with_na: bool = False) -> Vector:
    """length elements of the type's default (0, FALSE, "") or missing. raw has no missing: it stays 0."""
    kind = V.canonical(kind)
    if kind == "raw":
        value = F.lit(0)
    elif kind == "complex":
        value = F.lit(None) if populate_with_na else F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    else:
        value = F.lit(None if populate_with_na else DEFAULTS[kind])
    return Vector(_positions(spark, length), value.cast(V.SPARK_TYPE[kind]), kind, length)


def column(df: DataFrame, value: str | Column, position: Column, length: int | None = None, kind: str | None = None) -> Vector:
    """A table's column as a vector; position is an expression giving unique 1..n."""
    frame = df.withColumn("idx", position.cast("bigint"))
    value = F.col(value) if isinstance(value, str) else value
    kind = kind or V.of_spark(frame.select(value.alias("v")).schema["v"].dataType)
    return Vector(frame, value.cast(V.SPARK_TYPE[kind]), kind, length)


def generated(spark: SparkSession, populate: Callable[[int, int], object], length: int, kind: str, chunk: int = 1 << 17) -> Vector:
    """A user-defined source: ``populate(start, end)`` yields elements start (0-based) to end (exclusive).

    Runs on the executors, one call for each chunk; a lost task just calls it again.
    """
    chunks = -(-length // chunk)
    schema = V.T.StructType([V.T.StructField("idx", V.T.LongType()), V.T.StructField("value", V.SPARK_TYPE[kind])])

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c in batch["id"]:
                start, end = int(c) * chunk, min(length, (int(c) + 1) * chunk)
                yield pd.DataFrame({"idx": range(start + 1, end + 1), "value": populate(start, end)})

    frame = spark.range(0, chunks).mapInPandas(fill, schema) if chunks else spark.createDataFrame([], schema)
    return Vector(frame, "value", kind, length)
