"""Positions 1..n for frames that have none, without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row in partition below


def number_rows(df: DataFrame, name: str = "idx") -> DataFrame:
    """Adds positions 1..n in the frame's partition order.

    Two passes: a count for each partition, then each row's place is its partition's offset plus its
    place within. Needs a frame that yields the same partitions twice (a scan, or a sort by a unique key).
    """
    marked = df.withColumn("__row", F.monotonically_increasing_id())
    part = F.shiftright("__row", _ROW_BITS).alias("p")
    sizes = sorted((r["p"], r["count"]) for r in marked.groupBy(part).count().collect())
    offsets, total = {}, 0
    for p, n in sizes:
        offsets[p], total = total, total + n
    if not sizes:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    dense = [offsets.get(p, 0) for p in range(sizes[-1][0] + 1)]
    offset = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in dense]), (F.shiftright("__row", _ROW_BITS) + 1).cast("int")) if len(dense) <= 64 else None
    if offset is None:
        table = df.sparkSession.createDataFrame(list(offsets.items()), "__p bigint, __o bigint")
        placed = marked.withColumn("__p", F.shiftright("__row", _ROW_BITS)).join(F.broadcast(table), "__p")
        return placed.withColumn(name, F.col("__o") + F.col("__row").bitwiseAND((1 << _ROW_BITS) - 1) + 1).drop("__row", "__p", "__o")
    return marked.withColumn(name, offset + F.col("__row").bitwiseAND((1 << _ROW_BITS) - 1) + 1).drop("__row")


_BUCKET = 1 << 20  # most positions of a bucket


def renumber(df: DataFrame, by: str, most: int, name: str = "idx") -> tuple[DataFrame, int]:
    """Positions 1..n in the order of the unique column ``by``, whose values are in 1..most; and n.

    Values fall into buckets by division, so no sampling is needed and a task that runs again gives the same: a
    count for each bucket, then each row's place is its bucket's offset plus its rank there. df runs twice.
    """
    spark = df.sparkSession
    width = max(1, -(-most // max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-most // _BUCKET))))
    marked = df.withColumn("__b", F.expr(f"(`{by}` - 1) div {width}"))
    sizes = sorted((r["__b"], r["count"]) for r in marked.groupBy("__b").count().collect())  # one row a bucket
    offsets, total = [], 0
    for b, n in sizes:
        offsets.append((b, total))
        total += n
    table = spark.createDataFrame(offsets, "__b bigint, __o bigint")
    rank = F.row_number().over(W.partitionBy("__b").orderBy(by))
    placed = marked.withColumn("__r", rank).join(F.broadcast(table), "__b")
    return placed.withColumn(name, F.col("__o") + F.col("__r")).drop("__b", "__o", "__r"), total
