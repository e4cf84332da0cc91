"""Subscripts, subset and assignment.

A subscript becomes a frame ``(k, pos)``: k orders the result, pos is a position or missing. Contiguous
and strided slices never build it: they are filters with arithmetic renumbering. Exclusions are
anti-joins, renumbered by counts of each range of positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.functions import coerce, position
from stratavec.functions import types as V
from stratavec.operators.vector import Vector, is_vector, literal, small


class SubscriptError(IndexError):
    """A subscript mixes signs or has a type that cannot address elements."""


def from_values(spark, values: Sequence, kind: str | None = None) -> Vector:
    """A vector of driver-side values; small inputs such as literal subscripts."""
    kind = kind or next((literal(v)[0] for v in values if v is not None), "logical")
    if any(isinstance(v, float) for v in values) and kind == "integer":
        kind = "numeric"
    if kind == "numeric":
        values = [None if v is None else float(v) for v in values]
    rows = [(k + 1, (v.real, v.imag) if isinstance(v, complex) else v) for k, v in enumerate(values)]
    schema = V.T.StructType([V.T.StructField("idx", V.T.LongType(), False), V.T.StructField("value", V.SPARK_TYPE[kind])])
    return Vector(spark.createDataFrame(rows, schema), "value", kind, len(rows))


def _keep(df: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The non-dropped rows of a subscript, renumbered only if some were dropped."""
    kept = df.where("keep").drop("keep")
    new, m = position.renumber(kept.withColumnRenamed("k", "old"), "old", n, "k")
    return (kept, n) if m == n else (new.select("k", "pos"), m)


def subscript(x: Vector, s) -> tuple[DataFrame, int]:
    """Positions that the subscript s selects from x, as ``(k, pos)``, and how many.

    None selects nothing. Logical subscripts recycle over x and may run past its end (missing). Numbers:
    zeros are dropped, fractions truncated, out-of-range and missing stay missing, negatives exclude;
    signs may not be mixed, nor negatives and missing. Text selects the first element of that name;
    missing, empty and unknown names are missing.
    """
    spark, n = x.frame.sparkSession, x.length
    if s is None:
        return spark.range(0).select(F.col("id").alias("k"), F.col("id").alias("pos")), 0
    if not is_vector(s):
        s = from_values(spark, s if isinstance(s, (list, tuple, range)) else [s])
    at, v = F.col("idx").alias("k"), s.value
    if s.kind == "logical":
        return _by_mask(x, s)
    if s.kind in ("integer", "numeric"):
        if s.kind == "numeric":
            missing = v.isNull() | F.isnan(v)
            v = F.when(~missing, v)
        low, holes, high = s.frame.agg(F.min(v), F.count(F.when(v.isNull(), 1)), F.max(v)).first()
        if low is not None and low < 0:
            if holes or high > 0:
                raise SubscriptError("only zeros may be mixed with negative subscripts")
            gone = s.frame.where(v < 0).select((F.greatest(F.floor(-v), F.lit(1)) if s.kind == "numeric" else -v).cast("bigint").alias("pos")).distinct()
            left = x.frame.select(F.col("idx").alias("pos")).join(gone, "pos", "left_anti")
            new, m = position.renumber(left, "pos", n, "k")
            return new.select("k", "pos"), m
        whole = F.when(v <= n, F.floor(v).cast("bigint"))
        kept = s.frame.select(at, whole.alias("pos"), (v.isNull() | (v >= 1)).alias("keep"))
        return _keep(kept, s.length)
    if s.kind == "character":
        if x.names is None:
            return s.frame.select(at, F.lit(None).cast("bigint").alias("pos")), s.length
        first = x.frame.where(x.names.isNotNull() & (x.names != "")).groupBy(x.names.alias("name")).agg(F.min("idx").alias("pos"))
        return s.frame.select(at, v.alias("name")).join(first, "name", "left").select("k", "pos"), s.length
    raise SubscriptError(f"cannot subscript with {s.kind}")


def _by_mask(x: Vector, s: Vector) -> tuple[DataFrame, int]:
    n, m = x.length, s.length
    if not m or (not n and not m):
        return x.frame.sparkSession.range(0).select(F.col("id").alias("k"), F.col("id").alias("pos")), 0
    total = max(n, m)
    if s.frame is x.frame:
        both = x.frame.select(F.col("idx").alias("k"), s.value.alias("m"))
    elif m >= n:
        both = s.frame.select(F.col("idx").alias("k"), s.value.alias("m"))
    else:
        mask = s.frame.select(F.col("idx").alias("__at"), s.value.alias("m"))
        mask = small(mask, m, s.kind)
        both = x.frame.select(F.col("idx").alias("k")).withColumn("__at", F.pmod(F.col("k") - 1, F.lit(m)) + 1).join(mask, "__at")
    rows = both.select("k", F.when(F.col("m") & (F.col("k") <= n), F.col("k")).alias("pos"), (F.col("m").isNull() | F.col("m")).alias("keep"))
    return _keep(rows, total)


def _gather(x: Vector, rows: DataFrame, n: int) -> Vector:
    value = x.frame.select(F.col("idx").alias("pos"), x.value.alias("value"))
    out = small(rows, n, "integer").join(value, "pos", "left")  # rows are two numbers each
    missing = F.lit(0).cast("smallint") if x.kind == "raw" else None
    shown = F.coalesce(F.col("value"), missing) if missing is not None else F.col("value")
    return Vector(out.select(F.col("k").alias("idx"), shown.alias("value")), "value", x.kind, n)


def subset(x: Vector, s) -> Vector:
    """``x[s]``: a new vector without names; missing positions give missing values (raw: 0).

    A Python slice is a 1-based, inclusive range with an optional positive step: a filter, no join; over a
    source that can, only that range is scanned.
    """
    if isinstance(s, slice):
        start, stop, step = s.start or 1, min(s.stop or x.length, x.length), s.step or 1
        if start < 1 or step < 1:
            raise SubscriptError("slices start at 1 and go up")
        frame = x.source(start, stop) if x.source and stop >= start else x.frame.where(F.col("idx").between(start, stop))
        if step > 1:
            frame = frame.where((F.col("idx") - start) % step == 0)
        count = max(0, (stop - start) // step + 1) if stop >= start else 0
        moved = F.expr(f"(idx - {start}) div {step} + 1").alias("idx")
        return Vector(frame.select(moved, x.value.alias("value")), "value", x.kind, count)
    if is_vector(s) and s.frame is x.frame and s.kind == "logical":
        kept = x.frame.select("idx", x.value.alias("value"), s.value.alias("m")).where("m is null or m")
        value = F.when(F.col("m"), F.col("value"))
        value = F.coalesce(value, F.lit(0).cast("smallint")) if x.kind == "raw" else value
        out, n = position.renumber(kept.withColumnRenamed("idx", "old"), "old", x.length)
        return Vector(out.select("idx", value.alias("value")), "value", x.kind, n)
    return _gather(x, *subscript(x, s))


def cell(x: Vector, *at: int) -> Vector:
    """One element of an array, such as ``[i, j]`` of a matrix: a scan of one position, no join."""
    if not x.dim or len(x.dim) != len(at):
        raise SubscriptError(f"{len(at)} subscripts for {len(x.dim or ())} dimensions")
    if not all(1 <= i <= d for i, d in zip(at, x.dim)):
        raise SubscriptError("subscript out of bounds")
    place, step = 1, 1
    for i, d in zip(at, x.dim):
        place, step = place + (i - 1) * step, step * d
    return subset(x, slice(place, place))


def extract(x: Vector, *at: int | slice | Sequence[int] | None) -> Vector:
    """The array of the given places along each dimension, column-major as x: ``x[[3, 1], :, 2:5]``.

    A place is a position, a 1-based inclusive slice, a list of positions (any order, repeats allowed), or None for
    all of the dimension. Slices are filters with arithmetic on the coordinates; only lists are joined. Where the last
    dimensions are slices or single places, a source that can scans only their stretch.
    """
    if not x.dim or len(x.dim) != len(at):
        raise SubscriptError(f"{len(at)} subscripts for {len(x.dim or ())} dimensions")
    ranges: list[range | list[int]] = []
    for s, d in zip(at, x.dim):
        if s is None or isinstance(s, slice):
            s = s or slice(None)
            own: range | list[int] = range(s.start or 1, (d if s.stop is None else s.stop) + 1, s.step or 1)
            if (s.step or 1) < 1:
                raise SubscriptError("slices go up")
        else:
            own = [s] if isinstance(s, int) else list(s)
        if len(own) and not (1 <= min(own) and max(own) <= d):
            raise SubscriptError("subscript out of bounds")
        ranges.append(own)
    size, frame = 1, x.frame
    for d in x.dim:
        size *= d
    if all(len(r) for r in ranges):
        low = high = 0  # the stretch that holds all wanted elements, from 0
        for r, d in zip(reversed(ranges), reversed(x.dim)):
            low, high = low * d + min(r) - 1, high * d + max(r) - 1
        if x.source and high - low + 1 < size:
            frame = x.source(low + 1, high + 1)
        else:
            frame = frame.where(F.col("idx").between(low + 1, high + 1))
    else:
        frame = frame.where(F.lit(False))
    frame = frame.select("idx", x.value.alias("value"))
    place, step, new = F.lit(1).cast("bigint"), 1, 1
    for k, (r, d) in enumerate(zip(ranges, x.dim)):
        frame = frame.withColumn("__c", F.expr(f"(idx - 1) div {step} % {d} + 1"))
        if isinstance(r, range):
            frame = frame.where(F.col("__c").between(r.start, r.stop - 1) & ((F.col("__c") - r.start) % r.step == 0))
            own = F.expr(f"(__c - {r.start}) div {r.step}")
            frame = frame.withColumn(f"__p{k}", own).drop("__c")
        else:
            wanted = frame.sparkSession.createDataFrame([(c, p) for p, c in enumerate(r)], f"__c bigint, __p{k} bigint")
            frame = frame.join(small(wanted, len(r), "integer"), "__c").drop("__c")
        place, step, new = place + F.col(f"__p{k}") * new, step * d, new * len(r)
    out = frame.select(place.alias("idx"), "value")
    return Vector(out, "value", x.kind, new, dim=tuple(len(r) for r in ranges))


def is_in(x: Vector, members: Vector) -> Vector:
    """Whether each element of x is among the members (logical, never missing; missing is a member like any other).

    The members' distinct values are joined with x on the value, in the wider of the two types.
    """
    kind = x.kind if x.kind == members.kind else V.common(x.kind, members.kind)
    found = members.frame.select(coerce.cast(members.kind, kind, members.value).alias("member")).distinct().withColumn("there", F.lit(True))
    own = x.frame.select("idx", coerce.cast(x.kind, kind, x.value).alias("value"))
    out = own.join(found, F.col("value").eqNullSafe(F.col("member")), "left")
    return Vector(out.select("idx", F.coalesce("there", F.lit(False)).alias("value")), "value", "logical", x._length)


def count_members(x: Vector, members: Vector) -> DataFrame:
    """One row, column ``n``: elements of x that are among the members; a left-semi join."""
    kind = x.kind if x.kind == members.kind else V.common(x.kind, members.kind)
    found = members.frame.select(coerce.cast(members.kind, kind, members.value).alias("member"))
    own = x.frame.select(coerce.cast(x.kind, kind, x.value).alias("value"))
    return own.join(found, F.col("value").eqNullSafe(F.col("member")), "left_semi").agg(F.count("*").alias("n"))


def subscript_length(x: Vector, s) -> int:
    """How many elements ``x[s]`` has, without making them: a count or less of the subscript."""
    if isinstance(s, slice):
        start, stop, step = s.start or 1, min(s.stop or x.length, x.length), s.step or 1
        return max(0, (stop - start) // step + 1)
    if s is None:
        return 0
    if not is_vector(s):
        s = from_values(x.frame.sparkSession, s if isinstance(s, (list, tuple, range)) else [s])
    v = s.value
    if s.kind == "logical" and s.length:
        whole, rest = divmod(max(x.length, s.length), s.length)
        keep = v.isNull() | v
        one, part = s.frame.agg(F.count(F.when(keep, 1)), F.count(F.when(keep & (F.col("idx") <= rest), 1))).first()
        return whole * one + part
    if s.kind in ("integer", "numeric"):
        v = F.when(~(v.isNull() | F.isnan(v)), v) if s.kind == "numeric" else v
        low, holes, kept = s.frame.agg(F.min(v), F.count(F.when(v.isNull(), 1)), F.count(F.when(v >= 1, 1))).first()
        if low is None or low >= 0:
            return holes + kept
    return subscript(x, s)[1]


def assign(x: Vector, s, values) -> Vector:
    """``x[s] <- values`` as a new vector.

    Values are cast to x's type and recycled; their number must divide the number of positions. Missing
    positions are skipped; the last of several values for one position stays. Out-of-range positions, which
    a subscript reports as missing, change nothing.
    """
    spark = x.frame.sparkSession
    rows, n = (x.frame.select(F.col("idx").alias("k"), F.col("idx").alias("pos")).where(F.col("idx").between(s.start, s.stop)).select((F.col("k") - s.start + 1).alias("k"), "pos"), s.stop - s.start + 1) if isinstance(s, slice) else subscript(x, s)
    if not is_vector(values):
        values = from_values(spark, values if isinstance(values, (list, tuple)) else [values])
    m = values.length
    if not n:
        return x
    if not m or n % m:
        raise ValueError("number of items to replace is not a multiple of replacement length")
    new = values.frame.select(F.col("idx").alias("__at"), coerce.cast(values.kind, x.kind, values.value).alias("new"))
    new = small(new, m, x.kind)
    placed = rows.where("pos is not null").withColumn("__at", F.pmod(F.col("k") - 1, F.lit(m)) + 1).join(new, "__at")
    last = placed.groupBy("pos").agg(F.max_by(F.struct("new"), "k").alias("u"))
    out = x.frame.select("idx", x.value.alias("value")).join(last.withColumnRenamed("pos", "idx"), "idx", "left")
    out = out.select("idx", F.when(F.col("u").isNotNull(), F.col("u.new")).otherwise(F.col("value")).alias("value"))
    return Vector(out, "value", x.kind, x._length, None, x.dim)
