"""Casts between vector types; whatever cannot be represented is missing (NULL), nothing raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratavec.functions import types as V

# The texts that stand for logical values.
TRUE_TEXTS = ("T", "TRUE", "true", "True")
FALSE_TEXTS = ("F", "FALSE", "false", "False")

_REAL = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_COMPLEX_TEXT = rf"^\s*({_REAL})([+-](?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)i\s*$"
_IMAGINARY_TEXT = rf"^\s*({_REAL})i\s*$"
_HEX_TEXT = r"^\s*([+-]?)0[xX]([0-9a-fA-F]{1,13})\s*$"


def whole_to_int(x: Column) -> Column:
    """int32, or missing where it does not fit; INT_MIN itself is the missing value's pattern."""
    return F.when((x > V.INT_MIN) & (x <= V.INT_MAX), x).try_cast("int")


def real_to_int(x: Column) -> Column:
    """Truncates toward zero; NaN and values outside int32 are missing."""
    return F.when((x > V.INT_MIN) & (x < V.INT_MAX + 1.0), x).try_cast("int")


def text_to_real(s: Column) -> Column:
    """Decimal, hexadecimal, Inf and NaN texts, blanks around allowed; ``NA`` and others are missing."""
    bare = F.trim(s)
    plain = F.when(bare.rlike(rf"^{_REAL}$"), bare.try_cast("double"))
    negative, digits = F.regexp_extract(s, _HEX_TEXT, 1) == "-", F.regexp_extract(s, _HEX_TEXT, 2)
    hexed = F.conv(F.when(digits != "", digits), 16, 10).try_cast("double")
    low = F.lower(bare)
    named = F.when(low.isin("inf", "+inf", "infinity", "+infinity"), float("inf")).when(low.isin("-inf", "-infinity"), float("-inf")).when(bare == "NaN", float("nan"))
    return F.coalesce(plain, named, F.when(negative, -hexed).otherwise(hexed))


def text_to_logical(s: Column) -> Column:
    return F.when(s.isin(*TRUE_TEXTS), True).when(s.isin(*FALSE_TEXTS), False)


def text_to_complex(s: Column) -> Column:
    """``a+bi``, ``bi`` or a real number."""
    re, im = (F.regexp_extract(s, _COMPLEX_TEXT, k).try_cast("double") for k in (1, 2))
    alone = F.regexp_extract(s, _IMAGINARY_TEXT, 1).try_cast("double")
    real = text_to_real(s)
    return (
        F.when(im.isNotNull(), F.struct(re.alias("re"), im.alias("im")))
        .when(alone.isNotNull(), F.struct(F.lit(0.0).alias("re"), alone.alias("im")))
        .when(real.isNotNull(), F.struct(real.alias("re"), F.lit(0.0).alias("im")))
    )


def real_to_text(x: Column) -> Column:
    """The fewest of up to 15 significant digits that give the number to 15; in the shorter of plain and exponent notation.

    At equal width the plain one; exponents have a sign and two digits at least.
    """
    shown = F.format_string("%.14e", F.abs(x))
    digits = F.regexp_replace(F.replace(F.substring_index(shown, "e", 1), F.lit("."), F.lit("")), "0+$", "")
    digits = F.when(digits == "", "0").otherwise(digits)
    e, n = F.substring_index(shown, "e", -1).try_cast("int"), F.length(digits)
    behind = F.greatest(n - e - 1, F.lit(0))
    plain_width = F.greatest(e + 1, F.lit(1)) + F.when(behind > 0, behind + 1).otherwise(0)
    exponent_width = F.when(n > 1, n + 1).otherwise(1) + F.when(F.abs(e) >= 100, 5).otherwise(4)
    padded = F.rpad(digits, F.greatest(e + 1, n), "0")
    large = F.concat(F.substring(padded, F.lit(1), e + 1), F.when(n > e + 1, F.concat(F.lit("."), F.substring(padded, e + 2, n))).otherwise(""))
    plain = F.when(e >= 0, large).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits))
    exponent = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), F.when(F.abs(e) >= 100, 3).otherwise(2), "0"))
    number = F.concat(F.when(x < 0, "-").otherwise(""), F.when(plain_width <= exponent_width, plain).otherwise(exponent))
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "Inf").when(x == float("-inf"), "-Inf").otherwise(number)


def part_to_text(x: Column) -> Column:
    """A part of a complex number: whole numbers of up to 15 digits have no exponent, others are as :func:`real_to_text` has them."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.try_cast("bigint").cast("string")).otherwise(real_to_text(x))


def cast(source: str, target: str, a: Column) -> Column:
    """The column of vector type source as vector type target; missing stays missing.

    raw casts only to itself and to character (two hexadecimal digits); nothing casts to raw.
    """
    if source == target:
        return a
    if source == "raw" and target == "character":
        return F.lower(F.lpad(F.hex(a), 2, "0"))
    if "raw" in (source, target):
        raise V.VectorTypeError(f"cannot coerce {source} to {target}")
    re, im = (a.getField("re"), a.getField("im")) if source == "complex" else (None, None)
    if source == "complex":
        whole = a.isNotNull() & ~F.isnan(re) & ~F.isnan(im)
        if target == "numeric":
            return F.when(whole, re)
        if target == "integer":
            return F.when(whole, real_to_int(re))
        if target == "logical":
            return F.when(whole, (re != 0) | (im != 0))
        shown = F.concat(part_to_text(re), F.when(im >= 0, "+").otherwise(""), part_to_text(im), F.lit("i"))
        return F.when(whole, shown)
    if source == "character":
        return {"logical": text_to_logical, "integer": lambda s: real_to_int(text_to_real(s)), "numeric": text_to_real, "complex": text_to_complex}[target](a)
    if target == "complex":
        real = a.cast("int").cast("double") if source == "logical" else a.cast("double")
        return F.when(real.isNotNull(), F.struct(real.alias("re"), F.lit(0.0).alias("im")))
    if target == "numeric":
        return a.cast("int").cast("double") if source == "logical" else a.cast("double")
    if target == "integer":
        return real_to_int(a) if source == "numeric" else a.cast("int")
    if target == "logical":
        return F.when(~F.isnan(a), a != 0) if source == "numeric" else a != 0
    if source == "logical":
        return F.when(a, "TRUE").when(~a, "FALSE")
    return real_to_text(a) if source == "numeric" else a.cast("string")
