"""CSV tables as typed columns with positions.

``exact`` keeps this dialect: comma, newline, ``"`` quotes with doubled quotes; inside quotes a backslash
before a backslash is one backslash and before any other character both stay; blanks around a field are
skipped, inside quotes kept; a blank line is a row with an empty first cell; short rows are padded and long
rows widen the table. ``standard`` uses Spark's reader and lacks the backslash rule, blank lines and widening.
Either reads one file; a folder of several is an error, since positions would depend on their order.

Large files are split in both dialects. At the start of a line the exact one knows two states: a row begins, or the
line goes on inside quotes. One pass finds for each part of the file how it ends from either state, and how many rows
begin in it; put together, these give each part's state and first row number. Then parts are parsed by themselves, and
rows that lie across parts are put together from their pieces.

Column types come from one aggregation over all cells: text > numeric > integer > logical > nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavec.functions import coerce, position
from stratavec.functions import types as V
from stratavec.operators.vector import Vector

NA_TEXT = "NA"  # fixed value: the cell text of a missing value
_INTEGER = r"^\s*[+-]?[0-9]{1,10}$"
_REAL = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
#: Cell classes in rising order; a column has the highest it holds.
CLASSES = ("empty", "na", "logical", "integer", "numeric", "character")


class CsvError(ValueError):
    """Text that the dialect cannot read."""


_QUOTED = re.compile(r'[ \t]*"((?:[^"\\]|\\[\s\S]|"")*)"[ \t]*\r?(?=[,\n]|\Z)')
_PLAIN = re.compile(r"[^,\n]*")
_OPEN = re.compile(r'[ \t]*"')
_FIELD = re.compile(r'(?:\A|[,\n])[ \t]*"')  # where quotes open
_BODY = re.compile(r'(?:[^"\\]|\\[\s\S]|"")*+')  # what is inside; at its end a quote closes, or the text ends


def parse(text: str) -> Iterator[list[str]]:
    """Rows of cell texts."""
    at, row, end = 0, [], len(text)
    while at < end or row:
        if _OPEN.match(text, at):
            m = _QUOTED.match(text, at)
            if not m:
                raise CsvError(f"bad quoted field at character {at}")
            row.append(re.sub(r'""|\\\\', lambda x: x[0][0], m[1]))
        else:
            m = _PLAIN.match(text, at)
            row.append(m[0].strip(" \t\n\v\f\r"))
        at = m.end()
        if at < end and text[at] == ",":
            at += 1
            if at == end:
                row.append("")
                yield row
                return
            continue
        yield row
        row, at = [], at + 1


def quoted(text: str, inside: bool) -> tuple[list[tuple[int, int]], bool]:
    """Spans inside quotes of whole lines, each ended by a newline, and whether the end is inside; inside: the start is."""
    spans, at = [], 0
    while True:
        if not inside:
            m = _FIELD.search(text, at)
            if not m:
                return spans, False
            at = m.end()
        end = _BODY.match(text, at).end()
        spans.append((at, end))
        if end == len(text):
            return spans, True
        at, inside = end + 1, False


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, str, int]]:
    """(part, text, lines) of lines with their part, in order."""
    for batch in batches:
        for part, own in batch.groupby("part", sort=False):
            yield part, "".join(f"{line}\n" for line in own["value"]), len(own)


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each part, from either state at its start: the state at its end, and how many rows begin in it."""
    found: dict[int, list] = {}
    for part, text, lines in _parts(batches):
        own = found.setdefault(part, [False, True, 0, 0])
        for k in (0, 1):
            spans, end = quoted(text, own[k])
            # a line begins a row unless the one before ends inside quotes
            own[2 + k] += lines - sum(text.count("\n", a, b) for a, b in spans) + end - own[k]
            own[k] = end
    yield pd.DataFrame([(part, *own) for part, own in found.items()], columns=["part", "end0", "end1", "rows0", "rows1"])


def _row_end(text: str, spans: list[tuple[int, int]]) -> int:
    """Place of the first newline outside the spans, or -1."""
    at = 0
    for a, b in spans:
        if (k := text.find("\n", at, a)) >= 0:
            return k
        at = b
    return text.find("\n", at)


def _row_start(text: str, spans: list[tuple[int, int]]) -> int:
    """Start of the row that holds the last span."""
    for k in range(len(spans) - 1, -1, -1):
        if (at := text.rfind("\n", spans[k - 1][1] if k else 0, spans[k][0])) >= 0:
            return at + 1
    return 0


def _parsed(lines: DataFrame, starts: dict[int, tuple[bool, int]], keep: list[int] | None) -> DataFrame:
    """(at, cells) of all rows. starts: each part's state at its start, and the rows that begin before it.

    Pieces of rows that lie across parts come as text, and are put together by row.
    """
    columns = ["at", "cells", "part", "piece"]

    def cells(row: list[str]) -> list[str]:
        return row if keep is None else [row[k] if k < len(row) else "" for k in keep]

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, late, at = None, "", False, 0
        for part, text, _ in _parts(batches):
            if part != now:
                if held:
                    yield pd.DataFrame([(at, None, now, held)], columns=columns)
                now, held, (late, before) = part, "", starts[part]
                at = before - late  # late: the first row began in an earlier part
            text = held + text
            spans, end = quoted(text, late)
            if late:
                stop = _row_end(text, spans) + 1
                if not stop:
                    held = text
                    continue
                yield pd.DataFrame([(at, None, part, text[:stop])], columns=columns)
                text, spans, late, at = text[stop:], [(a - stop, b - stop) for a, b in spans if a >= stop], False, at + 1
            cut = _row_start(text, spans) if end else len(text)
            held, block = text[cut:], []
            for row in parse(text[:cut]):
                block.append((at, cells(row), None, None))
                at += 1
                if len(block) == 8192:
                    yield pd.DataFrame(block, columns=columns)
                    block = []
            yield pd.DataFrame(block, columns=columns)
        if held:
            yield pd.DataFrame([(at, None, now, held)], columns=columns)

    def whole(pieces: pd.DataFrame) -> pd.DataFrame:
        text = "".join(pieces.sort_values("part")["piece"])
        return pd.DataFrame({"at": pieces["at"].iloc[:1], "cells": [cells(next(parse(text)))]})

    got = lines.mapInPandas(parts, "at bigint, cells array<string>, part bigint, piece string")
    if not any(inside for inside, _ in starts.values()):
        return got.select("at", "cells")
    across = got.where("piece is not null").groupBy("at").applyInPandas(whole, "at bigint, cells array<string>")
    return got.where("piece is null").select("at", "cells").union(across)


def make_names(names: list[str]) -> list[str]:
    """Syntactic, unique names: other characters become dots, a bad start gets an X, repeats a number."""
    out, seen = [], {}
    for name in names:
        name = re.sub(r"[^\w.]", ".", name)
        if not re.match(r"[^\W\d_]|\.(?!\d)", name):
            name = f"X{name}"
        count = seen.get(name, -1) + 1
        seen[name] = count
        out.append(f"{name}.{count}" if count else name)
    return out


def cell_class(c: Column) -> Column:
    """Number of the cell's class in CLASSES."""
    code = {k: n for n, k in enumerate(CLASSES)}
    whole = c.rlike(_INTEGER) & c.try_cast("bigint").between(V.INT_MIN + 1, V.INT_MAX)
    return (
        F.when(c.isNull() | (F.trim(c) == ""), code["empty"])
        .when(c == NA_TEXT, code["na"])
        .when(c.isin(*coerce.TRUE_TEXTS, *coerce.FALSE_TEXTS), code["logical"])
        .when(whole, code["integer"])
        .when(c.rlike(_REAL), code["numeric"])
        .otherwise(code["character"])
    )


def typed(cells: DataFrame, columns: list[str]) -> dict[str, str]:
    """Vector type of each text column: one pass over all of them."""
    if not columns:
        return {}
    found = cells.agg(*[F.max(cell_class(F.col(f"`{c}`"))).alias(f"c{k}") for k, c in enumerate(columns)]).first()
    kinds = [CLASSES[x] if x is not None else "empty" for x in found]
    return {c: "logical" if k in ("empty", "na") else k for c, k in zip(columns, kinds)}


def convert(c: Column, kind: str) -> Column:
    """A cell text as a value; ``NA`` and texts of lower classes are missing, empty text stays text."""
    if kind == "character":
        return F.when(c != NA_TEXT, c).when(c.isNull(), "")
    return coerce.cast("character", kind, F.when(c != NA_TEXT, F.trim(c)))


class Table:
    """Typed columns over one frame with ``idx``; ``table["name"]`` is a vector."""

    def __init__(self, frame: DataFrame, kinds: dict[str, str]):
        self.frame, self.kinds = frame, kinds
        self.names = list(kinds)
        self._length: int | None = None

    def to_df(self) -> DataFrame:
        return self.frame

    def __len__(self) -> int:
        if self._length is None:
            self._length = self.frame.count()
        return self._length

    def __getitem__(self, name: str) -> Vector:
        return Vector(self.frame, F.col(f"`{name}`"), self.kinds[name], self._length)


def _finish(cells: DataFrame, columns: list[str], names: list[str], kinds: dict[str, str]) -> Table:
    out = cells.select("idx", *[convert(F.col(c), kinds[c]).alias(n) for c, n in zip(columns, names)])
    return Table(out, {n: kinds[c] for c, n in zip(columns, names)})


def _one_file(df: DataFrame, path: str) -> None:
    if len(files := df.inputFiles()) > 1:
        raise CsvError(f"{path} has {len(files)} files; read one")


def read(spark: SparkSession, path: str, header: bool = True, check_names: bool = True, col_names: list[str] | None = None, dialect: str = "exact", columns: list[str] | None = None) -> Table:
    """The file as a table with row numbers in ``idx``.

    columns: the names of those to keep, in this order; cells of others are split off but not handed on.
    """
    kinds, wanted = None, columns
    if dialect == "standard":
        raw = spark.read.csv(path, header=False, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE")
        _one_file(raw, path)
        raw = position.number_rows(raw)
        columns = [c for c in raw.columns if c != "idx"]
        first = raw.where("idx = 1").first() if header else None
        given = [first[c] or "" for c in columns] if header and first else []
        cells = raw.where("idx > 1").withColumn("idx", F.col("idx") - 1) if header else raw
    elif dialect == "exact":
        lines = spark.read.text(path, lineSep="\n")
        _one_file(lines, path)
        lines = lines.select("value", F.input_file_block_start().alias("part"))
        ends = {r["part"]: r for r in lines.mapInPandas(_ends, "part bigint, end0 boolean, end1 boolean, rows0 bigint, rows1 bigint").collect()}  # one row a part
        starts, inside, count = {}, False, 0
        for part in sorted(ends):
            starts[part] = inside, count
            count += ends[part]["rows1" if inside else "rows0"]
            inside = ends[part]["end1" if inside else "end0"]
        if inside:
            raise CsvError(f"{path} ends inside quotes")
        parsed = _parsed(lines, starts, None)
        # one pass for width, names and types: a row for each column comes back
        cell = parsed.select("at", F.posexplode("cells").alias("k", "cell"))
        seen = F.col("at") > 0 if header else F.lit(True)
        found = cell.groupBy("k").agg(F.max(F.when(seen, cell_class(F.col("cell")))).alias("class"), F.max(F.when(F.col("at") == 0, F.col("cell"))).alias("first")).collect()
        by = {r["k"]: r for r in found}
        columns = [f"c{k}" for k in range(len(by))]
        kinds = {f"c{k}": CLASSES[by[k]["class"] or 0] for k in by}
        kinds = {c: "logical" if k in ("empty", "na") else k for c, k in kinds.items()}
        given = [by[k]["first"] or "" for k in range(len(columns))] if header else []
    else:
        raise ValueError(f"unknown dialect: {dialect}")
    names = list(col_names) if col_names else (given if header else [f"V{k + 1}" for k in range(len(columns))])
    names += [""] * (len(columns) - len(names))
    if check_names:
        names = make_names(names)
    elif len(set(names)) < len(names) or "" in names:
        raise CsvError("names are empty or repeated: use check_names")
    if wanted is not None:
        if missing := set(wanted) - set(names):
            raise CsvError(f"no columns {sorted(missing)}")
        places = [names.index(n) for n in wanted]
        columns, names = [columns[k] for k in places], list(wanted)
    if dialect == "exact":
        if wanted is not None:
            parsed = _parsed(lines, starts, places)
        body = parsed.where("at > 0").withColumn("idx", F.col("at")) if header else parsed.withColumn("idx", F.col("at") + 1)
        cells = body.select("idx", *[F.coalesce(F.get(F.col("cells"), F.lit(k)), F.lit("")).alias(c) for k, c in enumerate(columns)])
    return _finish(cells, columns, names, kinds or typed(cells, columns))
