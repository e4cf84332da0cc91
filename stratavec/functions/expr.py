"""Element-wise operators as Column expressions, with missing values as NULL.

NULL is the missing value; a NaN that came from data stays NaN. All stay inside code generation and
none raises under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratavec.functions import coerce
from stratavec.functions import types as V

NAN, INF = float("nan"), float("inf")


def _nan_safe(kind_a: str, kind_b: str, a: Column, b: Column, out: Column) -> Column:
    """A comparison with NaN is missing."""
    bad = [F.isnan(c) for k, c in ((kind_a, a), (kind_b, b)) if k == "numeric"]
    return F.when(bad[0] if len(bad) == 1 else bad[0] | bad[1], None).otherwise(out) if bad else out


def _part(z: Column, name: str) -> Column:
    return z.getField(name)


def _complex(re: Column, im: Column, *inputs: Column) -> Column:
    whole = inputs[0].isNotNull()
    for c in inputs[1:]:
        whole = whole & c.isNotNull()
    return F.when(whole, F.struct(re.alias("re"), im.alias("im")))


def add(kind: str, a: Column, b: Column) -> Column:
    if kind == "complex":
        return _complex(_part(a, "re") + _part(b, "re"), _part(a, "im") + _part(b, "im"), a, b)
    return F.try_add(a, b) if kind == "integer" else a + b


def subtract(kind: str, a: Column, b: Column) -> Column:
    if kind == "complex":
        return _complex(_part(a, "re") - _part(b, "re"), _part(a, "im") - _part(b, "im"), a, b)
    return F.try_subtract(a, b) if kind == "integer" else a - b


def multiply(kind: str, a: Column, b: Column) -> Column:
    if kind == "complex":
        p, q, r, s = _part(a, "re"), _part(a, "im"), _part(b, "re"), _part(b, "im")
        return _complex(p * r - q * s, p * s + q * r, a, b)
    return F.try_multiply(a, b) if kind == "integer" else a * b


def negate(kind: str, a: Column) -> Column:
    if kind == "complex":
        return _complex(-_part(a, "re"), -_part(a, "im"), a)
    return F.try_subtract(F.lit(0), a) if kind == "integer" else -a


def real_divide(a: Column, b: Column) -> Column:
    """IEEE division: a zero divisor gives an infinity, or NaN for 0/0 and NaN/0."""
    by_zero = F.when((a == 0) | F.isnan(a), NAN).when(a > 0, INF).otherwise(-INF)
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def divide(kind: str, a: Column, b: Column) -> Column:
    if kind != "complex":
        return real_divide(a, b)
    p, q, r, s = _part(a, "re"), _part(a, "im"), _part(b, "re"), _part(b, "im")
    norm = r * r + s * s
    return _complex(real_divide(p * r + q * s, norm), real_divide(q * r - p * s, norm), a, b)


def int_divide(kind: str, a: Column, b: Column) -> Column:
    """Quotient rounded down."""
    if kind == "integer":
        q = F.floor(F.try_divide(a.cast("double"), b.cast("double")))
        return F.when(b != 0, coerce.whole_to_int(q))
    q = real_divide(a, b)
    return F.when(F.abs(q) < 2.0**52, F.floor(q).cast("double")).otherwise(q)


def modulo(kind: str, a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; by zero missing (integer) or NaN (numeric).

    Integer and finite numeric remainders come from the exact ``%``, moved into the divisor's sign. A
    finite number modulo an infinity is itself where the signs agree, else that infinity.
    """
    zero = F.lit(0).cast("int") if kind == "integer" else F.lit(0.0)
    rest = F.try_mod(a, b)
    moved = F.when((rest != 0) & ((rest < zero) != (b < zero)), rest + b).otherwise(rest)
    if kind == "integer":
        return F.when(b != 0, moved)
    endless = F.abs(b) == INF
    return (
        F.when(a.isNull() | b.isNull(), None)
        .when((b == 0) | F.isnan(a) | F.isnan(b) | (F.abs(a) == INF), NAN)
        .when(endless, F.when((a == 0) | ((a < 0) == (b < 0)), a).otherwise(b))
        .otherwise(moved)
    )


def power(kind: str, a: Column, b: Column) -> Column:
    """x^0 and 1^y are 1 even for a missing operand. Complex: polar form, 0^0 is 1."""
    if kind != "complex":
        return F.when((b == 0) | (a == 1), 1.0).otherwise(F.pow(a, b))
    p, q, r, s = _part(a, "re"), _part(a, "im"), _part(b, "re"), _part(b, "im")
    size, angle = F.hypot(p, q), F.atan2(q, p)
    log_size = F.when(size > 0, F.log(size)).otherwise(0.0)
    grown, turned = F.exp(r * log_size - s * angle), r * angle + s * log_size
    none = (r == 0) & (s == 0)
    re = F.when(none, 1.0).when(size == 0, 0.0).otherwise(grown * F.cos(turned))
    im = F.when(none | (size == 0), 0.0).otherwise(grown * F.sin(turned))
    return _complex(re, im, a, b)


ARITHMETIC = {"+": (V.arithmetic, add), "-": (V.arithmetic, subtract), "*": (V.arithmetic, multiply), "/": (V.division, divide),
              "^": (V.division, power), "%%": (V.modular, modulo), "%/%": (V.modular, int_divide)}
ORDER = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}
BINARY = (*ARITHMETIC, *ORDER, "==", "!=", "&", "|")


def _common(x: str, y: str) -> str:
    """The type in which two operands are compared."""
    if "character" in (x, y):
        return "character"
    return V.arithmetic("compare", x, y)


def binary(op: str, x: str, a: Column, y: str, b: Column, collation: str | None = None) -> tuple[str, Column]:
    """Result type and expression of ``a op b`` for columns of vector types x and y.

    collation: name of a Spark collation for text comparison; None compares bytes.
    """
    if op in ARITHMETIC:
        rule, build = ARITHMETIC[op]
        kind = rule(op, x, y)
        return kind, build(kind, coerce.cast(x, kind, a), coerce.cast(y, kind, b))
    if op in ("&", "|"):
        kind = V.boolean(op, x, y)
        a, b = coerce.cast(x, "logical", a), coerce.cast(y, "logical", b)
        return kind, (a & b) if op == "&" else (a | b)
    kind = V.ordering(op, x, y) if op in ORDER else V.equality(op, x, y)
    via = _common(x, y)
    a, b = coerce.cast(x, via, a), coerce.cast(y, via, b)
    if via == "character" and collation:
        a, b = F.collate(a, collation), F.collate(b, collation)
    if via == "complex":
        same = (_part(a, "re") == _part(b, "re")) & (_part(a, "im") == _part(b, "im"))
        bad = F.isnan(_part(a, "re")) | F.isnan(_part(a, "im")) | F.isnan(_part(b, "re")) | F.isnan(_part(b, "im"))
        out = F.when(~bad, same)
    else:
        out = _nan_safe(via, via, a, b, ORDER[op](a, b) if op in ORDER else a == b)
    return kind, ~out if op == "!=" else out


def unary(op: str, x: str, a: Column) -> tuple[str, Column]:
    """Result type and expression of ``+a``, ``-a`` or ``!a``."""
    if op == "!":
        if x == "raw" or x == "character":
            raise V.VectorTypeError(f"operation is not supported: ! on {x}")
        return "logical", ~coerce.cast(x, "logical", a)
    kind = V.sign(op, x)
    a = coerce.cast(x, kind, a)
    return kind, a if op == "+" else negate(kind, a)
