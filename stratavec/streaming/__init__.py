"""Element-wise expressions over unbounded frames.

The vector algebra has no stateful operators. Its element-wise operators are plain Column expressions,
so they run unchanged on a frame from ``readStream``; positions, recycling and subscripts need a finite
length and are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.functions import expr
from stratavec.functions import types as V


def map_stream(df: DataFrame, column: str, op: str, operand) -> DataFrame:
    """A streaming (or batch) frame with ``column`` replaced by ``column op operand``, a scalar."""
    x = V.of_spark(df.schema[column].dataType)
    y = {bool: "logical", int: "integer", float: "numeric", str: "character"}[type(operand)]
    _, out = expr.binary(op, x, F.col(column).cast(V.SPARK_TYPE[x]), y, F.lit(operand).cast(V.SPARK_TYPE[y]))
    return df.withColumn(column, out)
