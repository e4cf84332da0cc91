"""Vector types, their Spark types, and the result-type rules of the element-wise operators."""

from __future__ import annotations

from pyspark.sql import types as T

COMPLEX = T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])

SPARK_TYPE = {
    "logical": T.BooleanType(),
    "integer": T.IntegerType(),
    "numeric": T.DoubleType(),
    "complex": COMPLEX,
    "raw": T.ShortType(),
    "character": T.StringType(),
}
ALIASES = {"double": "numeric", "string": "character"}
NUMBERS = ("logical", "integer", "numeric")

INT_MIN, INT_MAX = -(2**31), 2**31 - 1


class VectorTypeError(TypeError):
    """An operator does not support the types of its operands."""


def canonical(name: str) -> str:
    """Type name without aliases; unknown names are an error."""
    name = ALIASES.get(name, name)
    if name not in SPARK_TYPE:
        raise ValueError(f"unknown vector type: {name}")
    return name


def of_spark(kind: T.DataType) -> str:
    """The vector type that holds a Spark column of this type."""
    if isinstance(kind, T.BooleanType):
        return "logical"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return "integer"
    if isinstance(kind, (T.LongType, T.FloatType, T.DoubleType, T.DecimalType)):
        return "numeric"
    if isinstance(kind, T.StructType):
        return "complex"
    return "character"


def common(x: str, y: str) -> str:
    """The type that holds both: logical < integer < numeric < complex < character; raw only with itself."""
    order = ("logical", "integer", "numeric", "complex", "character")
    if x != y and "raw" in (x, y):
        raise VectorTypeError(f"no common type of {x} and {y}")
    return x if x == y else max(x, y, key=order.index)


def _refuse(op: str, x: str, y: str | None):
    raise VectorTypeError(f"operation is not supported: {op} on {x}" + (f" and {y}" if y else ""))


def arithmetic(op: str, x: str, y: str) -> str:
    """+ - *: complex, else numeric, else integer."""
    if not {x, y} <= {*NUMBERS, "complex"}:
        _refuse(op, x, y)
    return "complex" if "complex" in (x, y) else "numeric" if "numeric" in (x, y) else "integer"


def division(op: str, x: str, y: str) -> str:
    """/ and ^: complex, else always numeric."""
    return "complex" if arithmetic(op, x, y) == "complex" else "numeric"


def modular(op: str, x: str, y: str) -> str:
    """%% and %/%: real numbers only."""
    kind = arithmetic(op, x, y)
    return kind if kind != "complex" else _refuse(op, x, y)


def ordering(op: str, x: str, y: str) -> str:
    """< <= > >=: real numbers with each other or with text, text with text; never complex or raw."""
    if not {x, y} <= {*NUMBERS, "character"}:
        _refuse(op, x, y)
    return "logical"


def equality(op: str, x: str, y: str) -> str:
    """== and !=: anything but raw."""
    if "raw" in (x, y):
        _refuse(op, x, y)
    return "logical"


def boolean(op: str, x: str, y: str) -> str:
    """& and |: numbers and complex by truth value, text by its logical literals."""
    return equality(op, x, y)


def sign(op: str, x: str) -> str:
    """Unary + and -: keeps the type, logical becomes integer."""
    if x not in (*NUMBERS, "complex"):
        _refuse(op, x, None)
    return "integer" if x == "logical" else x
