"""CSV files: separator, header and types are sniffed from the first 100,000 characters, cells are parsed leniently."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabgraph.errors import CSVTooShort, DuplicateColumn
from tabgraph.operators.frame import Table

SNIFF = 100_000
SEPARATORS = ",\t|"
#: Marks that tell a quoted empty cell from an unquoted one.
EMPTY = {"nullValue": "\u0000", "emptyValue": "\u0001"}
#: The first type, by priority, whose pattern fits every cell; an empty cell fits all.
TYPES = (("bigint", re.compile(r"\s*-?\d+\s*")), ("boolean", re.compile(r"\s*(t|true|f|false|0|1)\s*", re.I)), ("double", re.compile(r"\s*(-?\d+(\.\d*)?|nan|[+-]?inf(inity)?)\s*", re.I)), ("string", re.compile(r".*", re.S)))


@dataclass(frozen=True)
class Guess:
    separator: str
    has_header: bool
    names: tuple[str, ...]
    types: tuple[str, ...]


def fits(cell: str, kind: str) -> bool:
    return cell == "" or bool(dict(TYPES)[kind].fullmatch(cell))


def _kind(cells: list[str]) -> str:
    return next(k for k, p in TYPES if all(c == "" or p.fullmatch(c) for c in cells))


def pick_separator(lines: list[str]) -> str:
    """The first that stands equally often on every line (the last may differ), else the one with the fewest lines that
    differ from the most common number, among those that occur; else a comma."""
    best, least = ",", len(lines) + 1
    for s in SEPARATORS:
        counts = [line.count(s) for line in lines]
        full = counts[:-1] if len(counts) > 2 else counts
        if full[0] and len(set(full)) == 1:
            return s
        if any(full):
            usual = max(set(full), key=full.count)
            if usual and (off := sum(c != usual for c in full)) < least:
                best, least = s, off
    return best


def sniff(text: str) -> Guess:
    """Quotes are not looked at. A header is there if all columns are text with the first row and some is not without it."""
    whole = len(text) <= SNIFF
    lines = [x.removesuffix("\r") for x in text[:SNIFF].split("\n")]
    if whole and lines and lines[-1] == "":
        lines.pop()
    if len(lines) < 2:
        raise CSVTooShort("fewer than two lines")
    sep = pick_separator(lines)
    rows = [x.split(sep) for x in lines]
    width = max(map(len, rows))
    if len(rows) > 2 and len(rows[-1]) < width:
        rows.pop()
    column = lambda i, first: [r[i] for r in rows[first:] if i < len(r)]
    all_, rest = [_kind(column(i, 0)) for i in range(width)], [_kind(column(i, 1)) for i in range(width)]
    header = all(k == "string" for k in [k for i, k in enumerate(all_) if i < len(rows[0])]) and any(k != "string" for k in rest)
    if header:
        names = [rows[0][i].strip() if i < len(rows[0]) and rows[0][i].strip() else f"col_{i}" for i in range(width)]
    else:
        names = [f"c{i}" for i in range(width)]
    return Guess(sep, header, tuple(names), tuple(rest if header else all_))


def cell(c: Column, kind: str) -> Column:
    """A text cell as a value, null where it does not parse: integers by their leading digits, numbers by their longest
    numeric beginning, booleans by 0, 1, t, f, true… and false…"""
    if kind == "bigint":
        return F.regexp_extract(c, r"^ *([+-]?\d+)", 1).try_cast("bigint")
    if kind == "double":
        number = F.regexp_extract(c, r"(?i)^\s*([+-]?(?:\d+\.?\d*(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?|nan|inf(?:inity)?))", 1)
        low = F.lower(number)
        return F.when(low.rlike("nan"), float("nan")).when(low.rlike("^-inf"), float("-inf")).when(low.rlike("inf"), float("inf")).otherwise(number.try_cast("double"))
    if kind == "boolean":
        low = F.lower(F.ltrim(c))
        return F.when(low.rlike(r"^(1\s*|t\s*|true.*)$"), True).when(low.rlike(r"^(0\s*|f\s*|false.*)$"), False)
    return F.regexp_replace(c, r"\\(.)", "$1")


def told(c: Column) -> Column:
    """A cell as read under EMPTY: an unquoted empty one is null, a quoted one the empty text."""
    return F.when(c == EMPTY["emptyValue"], F.lit("")).otherwise(F.when(c != "", c))


def prefix(spark: SparkSession, path: str) -> str:
    """About the first 100,000 characters, by lines; only the first partitions are read."""
    got, size, step = [], 0, 256
    while size <= SNIFF:
        got = [r[0] for r in spark.read.text(path).take(step)]
        size = sum(map(len, got)) + len(got)
        if len(got) < step:
            break
        step *= 4
    return "\n".join(got)


def read_csv(spark: SparkSession, path: str, guess: Guess | None = None, multi_line: bool = True) -> Table:
    """A lazy scan of text columns under one projection of parsed cells. Short rows are filled with nulls, long ones cut;
    an unquoted empty cell is null, a quoted one the empty text; newlines may stand in quotes, for which each file is
    read by one task: with multi_line=False, for files without them, large files are split."""
    g = guess or sniff(prefix(spark, path))
    if len(set(g.names)) < len(g.names):
        raise DuplicateColumn(", ".join(g.names))
    raw = ", ".join(f"_{i} string" for i in range(len(g.names)))
    text = spark.read.schema(raw).options(sep=g.separator, header=g.has_header, quote='"', escape="\\", multiLine=multi_line, mode="PERMISSIVE", enforceSchema=True, **EMPTY).csv(path)
    return Table(text.select(*(cell(told(F.col(f"_{i}")), k).alias(n) for i, (n, k) in enumerate(zip(g.names, g.types)))))


def read_string(spark: SparkSession, text: str, guess: Guess | None = None) -> Table:
    """Like read_csv, of a text in memory, in the order of its records. An open quote at a line's end goes on in the next."""
    g, records, open_ = guess or sniff(text), [], False
    for line in text.removesuffix("\n").split("\n"):
        line = line.removesuffix("\r")
        odd = len(re.sub(r"\\.", "", line).split('"')) % 2 == 0
        if open_:
            records[-1] += "\n" + line
        else:
            records.append(line)
        open_ = open_ != odd
    if len(set(g.names)) < len(g.names):
        raise DuplicateColumn(", ".join(g.names))
    rows = [(i, r) for i, r in enumerate(records[g.has_header :]) if r]
    lines = spark.createDataFrame(rows, "__pos long, value string")
    return Table(parse_rows(spark, lines, g, "__pos"))


def parse_rows(spark: SparkSession, lines: DataFrame, guess: Guess, *keep: str) -> DataFrame:
    """Rows of an existing text column `value` (one record each) parsed like those of a file, with the columns `keep`."""
    names = ", ".join(f"_{i} string" for i in range(len(guess.names)))
    options = {"sep": guess.separator, "escape": "\\", "multiLine": "true", **EMPTY}
    parsed = lines.select(F.from_csv("value", names, options).alias("r"), *keep)
    return parsed.select(*keep, *(cell(told(F.col(f"r._{i}")), k).alias(n) for i, (n, k) in enumerate(zip(guess.names, guess.types))))
