"""The Vector: a frame with positions ``idx`` 1..n and a Column expression over it.

Operators on vectors of one frame are projections: Catalyst fuses chains of them. Vectors of different
frames are joined on position; a shorter operand is recycled by a join on ``(idx - 1) mod its length``.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavec.functions import coerce, expr
from stratavec.functions import types as V

#: Operands of at most this many elements of fixed width are broadcast when joined (24 bytes each, so 5 MB at most).
#: Longer ones, and texts, whose size a count doesn't tell, are left to Spark, which knows their bytes when they are shuffled.
BROADCAST_ELEMENTS = 200_000


def small(df: DataFrame, elements: int, kind: str) -> DataFrame:
    """df with a broadcast hint, if that many elements of the type are small for certain."""
    return F.broadcast(df) if elements <= BROADCAST_ELEMENTS and kind != "character" else df
SCALARS = {bool: "logical", int: "integer", float: "numeric", complex: "complex", str: "character"}


class Vector:
    """A typed, lazily evaluated vector. frame must hold a unique ``idx`` running from 1 to n."""

    def __init__(self, frame: DataFrame, value: Column | str, kind: str, length: int | None = None, names: Column | None = None, dim: tuple[int, ...] | None = None, source=None):
        self.frame, self.kind, self._length, self.names, self.dim = frame, V.canonical(kind), length, names, dim
        self.value = F.col(value) if isinstance(value, str) else value
        self.source = source  # callable(start, stop) -> frame of these positions only, if the scan can do that

    # -- metadata ---------------------------------------------------------------------------------
    @property
    def length(self) -> int:
        """Number of elements; counted once if the source doesn't know it."""
        if self._length is None:
            self._length = self.frame.count()
        return self._length

    def __len__(self) -> int:
        return self.length

    def reshape(self, *dim: int) -> "Vector":
        """The same elements as a column-major array; a matrix may use a prefix of the vector."""
        size = 1
        for d in dim:
            size *= d
        if size > self.length:
            raise ValueError(f"dimensions hold {size} elements, the vector {self.length}")
        frame = self.frame if size == self.length else self.frame.where(F.col("idx") <= size)
        return Vector(frame, self.value, self.kind, size, self.names, dim, self.source)

    def set_names(self, names: Column | str) -> "Vector":
        """Names are a string expression over the same frame."""
        return Vector(self.frame, self.value, self.kind, self._length, F.col(names) if isinstance(names, str) else names, self.dim, self.source)

    def named_by(self, other: "Vector") -> "Vector":
        """Names from another vector of the same length."""
        joined = self.to_df().join(other.frame.select("idx", other.value.alias("name")), "idx")
        return Vector(joined, "value", self.kind, self._length, F.col("name"))

    # -- frames -----------------------------------------------------------------------------------
    def to_df(self, value: str = "value") -> DataFrame:
        return self.frame.select("idx", self.value.alias(value))

    def cells(self) -> DataFrame:
        """Array coordinates and values: i, j for a matrix, i1..ik else."""
        if not self.dim:
            raise ValueError("the vector has no dimensions")
        labels = ["i", "j"] if len(self.dim) == 2 else [f"i{k + 1}" for k in range(len(self.dim))]
        step, out = 1, []
        for label, d in zip(labels, self.dim):
            out.append((F.expr(f"(idx - 1) div {step} % {d}") + 1).alias(label))
            step *= d
        return self.frame.select(*out, self.value.alias("value"))

    def collect(self) -> list:
        """Values in order, on the driver: for tests and small results."""
        return [r["value"] for r in self.to_df().orderBy("idx").collect()]

    def __iter__(self):
        """Elements in order, one partition at a time. The driver gets them all: :meth:`fold` loops where they are."""
        for r in self.to_df().orderBy("idx").toLocalIterator():
            yield r["value"]

    def fold(self, start, step: Callable, join: Callable):
        """A loop over all elements in order, on the executors; only one state a task comes to the driver.

        Each task has a run of elements and does ``state = step(state, idx, value)`` for one after another, from
        ``start`` on; ``join(state, next)`` puts the states of neighbouring runs together, in order. So start must be
        neutral for join. States are pickled; complex values are dicts of re and im.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state, first = start, None
            for batch in batches:
                at, values = (c.to_pylist() for c in batch.columns)
                first = at[0] if first is None and at else first
                for k, v in zip(at, values):
                    state = step(state, k, v)
            if first is not None:
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())], ["first", "state"])

        runs = self.to_df().orderBy("idx").mapInArrow(run, "first bigint, state binary").collect()
        return reduce(join, (pickle.loads(r["state"]) for r in sorted(runs, key=lambda r: r["first"])), start)

    # -- element-wise -----------------------------------------------------------------------------
    def map(self, value: Column, kind: str) -> "Vector":
        return Vector(self.frame, value, kind, self._length, self.names, self.dim)

    def cast(self, kind: str) -> "Vector":
        return self.map(coerce.cast(self.kind, V.canonical(kind), self.value), kind)

    def _op(self, op: str, other, swap: bool = False) -> "Vector":
        x, y = (other, self) if swap else (self, other)
        return binary(op, x, y)

    __add__ = lambda self, o: self._op("+", o)
    __radd__ = lambda self, o: self._op("+", o, True)
    __sub__ = lambda self, o: self._op("-", o)
    __rsub__ = lambda self, o: self._op("-", o, True)
    __mul__ = lambda self, o: self._op("*", o)
    __rmul__ = lambda self, o: self._op("*", o, True)
    __truediv__ = lambda self, o: self._op("/", o)
    __rtruediv__ = lambda self, o: self._op("/", o, True)
    __floordiv__ = lambda self, o: self._op("%/%", o)
    __rfloordiv__ = lambda self, o: self._op("%/%", o, True)
    __mod__ = lambda self, o: self._op("%%", o)
    __rmod__ = lambda self, o: self._op("%%", o, True)
    __pow__ = lambda self, o: self._op("^", o)
    __rpow__ = lambda self, o: self._op("^", o, True)
    __lt__ = lambda self, o: self._op("<", o)
    __le__ = lambda self, o: self._op("<=", o)
    __gt__ = lambda self, o: self._op(">", o)
    __ge__ = lambda self, o: self._op(">=", o)
    __eq__ = lambda self, o: self._op("==", o)
    __ne__ = lambda self, o: self._op("!=", o)
    __and__ = lambda self, o: self._op("&", o)
    __rand__ = lambda self, o: self._op("&", o, True)
    __or__ = lambda self, o: self._op("|", o)
    __ror__ = lambda self, o: self._op("|", o, True)
    __hash__ = object.__hash__

    def __neg__(self) -> "Vector":
        return unary("-", self)

    def __pos__(self) -> "Vector":
        return unary("+", self)

    def __invert__(self) -> "Vector":
        return unary("!", self)

    def __getitem__(self, subscript) -> "Vector":
        from stratavec.operators import index

        if isinstance(subscript, tuple):
            return (index.cell if all(isinstance(s, int) for s in subscript) else index.extract)(self, *subscript)
        return index.subset(self, subscript)

    def is_in(self, members: "Vector") -> "Vector":
        """Whether each element is among the members."""
        from stratavec.operators import index

        return index.is_in(self, members)

    # -- reductions -------------------------------------------------------------------------------
    def sum(self, na_rm: bool = False) -> DataFrame:
        """One row, column ``sum``: missing if any element is and na_rm is off; 0 for no elements."""
        if self.kind in ("character", "raw"):
            raise V.VectorTypeError(f"operation is not supported: sum of {self.kind}")
        if self.kind == "complex":
            parts = [F.sum(self.value.getField(p)) for p in ("re", "im")]
            total = F.struct(*(F.coalesce(s, F.lit(0.0)).alias(p) for s, p in zip(parts, ("re", "im"))))
        else:
            x = self.value.cast("int") if self.kind == "logical" else self.value
            zero = F.lit(0.0) if self.kind == "numeric" else F.lit(0).cast("bigint")
            total = F.coalesce(F.sum(x), zero)
        whole = F.count(F.lit(1)) == F.count(self.value)
        return self.frame.agg((total if na_rm else F.when(whole, total)).alias("sum"))

    def _extreme(self, f, name: str, na_rm: bool) -> DataFrame:
        whole = F.count(F.lit(1)) == F.count(self.value)
        return self.frame.agg((f(self.value) if na_rm else F.when(whole, f(self.value))).alias(name))

    def min(self, na_rm: bool = False) -> DataFrame:
        return self._extreme(F.min, "min", na_rm)

    def max(self, na_rm: bool = False) -> DataFrame:
        return self._extreme(F.max, "max", na_rm)


def is_vector(x) -> bool:
    return isinstance(x, Vector)


def difference(x: Vector, y: Vector, tolerance: float = 0.0) -> DataFrame:
    """One row, ``n_different``: positions whose values differ (missing equals missing) or are in one only."""
    a, b = x.to_df("a").withColumn("in_a", F.lit(1)), y.to_df("b").withColumn("in_b", F.lit(1))
    same = F.col("a").eqNullSafe(F.col("b"))
    if tolerance and x.kind == y.kind == "numeric":
        same = same | F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance, F.lit(False))
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    return a.join(b, "idx", "full_outer").agg(F.count(F.when(~(both & same), 1)).alias("n_different"))


def literal(value) -> tuple[str, Column]:
    """Vector type and expression of a scalar; None is a missing logical."""
    if value is None:
        return "logical", F.lit(None).cast("boolean")
    kind = SCALARS.get(type(value))
    if kind is None:
        raise V.VectorTypeError(f"not a vector or scalar: {type(value).__name__}")
    if kind == "complex":
        return kind, F.struct(F.lit(value.real).alias("re"), F.lit(value.imag).alias("im"))
    if kind == "integer" and not V.INT_MIN < value <= V.INT_MAX:
        return "numeric", F.lit(float(value))
    return kind, F.lit(value).cast(V.SPARK_TYPE[kind])


def align(*vectors: Vector) -> tuple[DataFrame, list[Column], int | None]:
    """One frame with ``idx`` and an expression for each vector; recycled to the longest, empty if any is."""
    if all(v.frame is vectors[0].frame for v in vectors):
        return vectors[0].frame, [v.value for v in vectors], vectors[0]._length
    lengths = [v.length for v in vectors]
    longest = max(lengths) if min(lengths) else 0
    lead = lengths.index(max(lengths))
    frame = vectors[lead].frame.select("idx", vectors[lead].value.alias(f"v{lead}"))
    if not longest:
        frame = frame.limit(0)
    for k, v in enumerate(vectors):
        if k == lead:
            continue
        own = v.frame.select(F.col("idx").alias("__at"), v.value.alias(f"v{k}"))
        if not longest:
            frame = frame.withColumn(f"v{k}", F.lit(None).cast(V.SPARK_TYPE[v.kind]))
        elif lengths[k] == longest:
            frame = frame.join(own.withColumnRenamed("__at", "idx"), "idx")
        else:
            own = small(own, lengths[k], v.kind)
            place = F.pmod(F.col("idx") - 1, F.lit(lengths[k])) + 1
            frame = frame.withColumn("__at", place).join(own, "__at").drop("__at")
    return frame, [F.col(f"v{k}") for k in range(len(vectors))], longest


def binary(op: str, x, y, collation: str | None = None) -> Vector:
    """``x op y`` for vectors and scalars; op is one of + - * / ^ %% %/% < <= > >= == != & |."""
    if not is_vector(x) and not is_vector(y):
        raise V.VectorTypeError("one operand must be a vector")
    if not is_vector(y) or not is_vector(x):
        v, s = (x, y) if is_vector(x) else (y, x)
        kind, value = literal(s)
        pair = (v.kind, v.value, kind, value) if is_vector(x) else (kind, value, v.kind, v.value)
        out, value = expr.binary(op, *pair, collation)
        return v.map(value, out)
    frame, (a, b), n = align(x, y)
    out, value = expr.binary(op, x.kind, a, y.kind, b, collation)
    return Vector(frame, value, out, n, x.names if frame is x.frame else None, x.dim if n == x._length else y.dim)


def unary(op: str, x: Vector) -> Vector:
    """``+x``, ``-x`` or ``!x``."""
    kind, value = expr.unary(op, x.kind, x.value)
    return x.map(value, kind)


#: The operators by name.
def add(x, y=None):
    return unary("+", x) if y is None else binary("+", x, y)


def subtract(x, y=None):
    return unary("-", x) if y is None else binary("-", x, y)


def _named(op):
    return lambda x, y: binary(op, x, y)


multiply, divide, int_divide, power, modulo = map(_named, ("*", "/", "%/%", "^", "%%"))
less, less_equal, greater, greater_equal, equal, unequal = map(_named, ("<", "<=", ">", ">=", "==", "!="))
logical_or, logical_and = map(_named, ("|", "&"))


def logical_not(x: Vector) -> Vector:
    return unary("!", x)
