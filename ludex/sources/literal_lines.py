"""Ingest of Python-literal lines (A3): one dict literal per line, e.g.
``{'user_id': u'a', 'ok': True, 'n': None}``.

Spark's JSON reader cannot read these (single quotes, ``u''`` prefixes, ``True``,
``None``), so each Arrow batch of lines is converted to JSON text in Python with the
standard library's literal parser (plain lines, which are JSON but for quotes and constants,
with its much faster JSON parser), and the typed parse with the declared schema then runs
on the JVM (``from_json``). Values of another type than declared are converted where that
loses nothing (``'30'`` or ``30.0`` to 30, a number to text). A line whose value cannot be
converted, and a line that does not parse, go to a quarantine frame with the line, the
field and the error; nothing becomes null unseen. Raw text is kept for those lines only.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, StringType, StructType

from ludex.session import ship_package
from ludex.sources.text_lines import read_numbered_lines

_PARSED = "line string, json string, field string, error string"

# Tokens that a plain line consists of: strings without quotes, escapes or control signs,
# numbers that JSON writes alike, constants. Matched from the start and without going back.
_STRING = r"""u?'([^'"\\\x00-\x1f]*+)'|u?"([^'"\\\x00-\x1f]*+)\""""
_PLAIN = re.compile(rf"""(?:[ {{}}\[\],:]++|{_STRING}|None|True|False|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+)*+""")
_REWRITTEN = re.compile(rf"{_STRING}|None|True|False")
_CONSTANTS = {"None": "null", "True": "true", "False": "false"}


def literal(line: str) -> object:
    """``ast.literal_eval(line)``. A plain line is rewritten to JSON; where that is not read
    either, the literal parser decides."""
    if _PLAIN.fullmatch(line):
        try:
            return json.loads(_REWRITTEN.sub(lambda m: _CONSTANTS.get(m[0]) or f'"{m[m.lastindex]}"', line))
        except (ValueError, RecursionError):
            pass
    return ast.literal_eval(line)


class FieldError(ValueError):
    def __init__(self, field: str, value: object, dtype: DataType):
        super().__init__(f"{type(value).__name__} is not {dtype.simpleString()}")
        self.field = field


def convert(value: object, dtype: DataType, field: str) -> object:
    """``value`` as ``dtype``, or a FieldError naming the field; None stays."""
    if value is None:
        return None
    if isinstance(dtype, StructType):
        if not isinstance(value, dict):
            raise FieldError(field, value, dtype)
        prefix = f"{field}." if field else ""
        return {f.name: convert(value.get(f.name), f.dataType, prefix + f.name) for f in dtype.fields}
    if isinstance(dtype, ArrayType):
        if not isinstance(value, (list, tuple)):
            raise FieldError(field, value, dtype)
        return [convert(v, dtype.elementType, field) for v in value]
    if isinstance(dtype, StringType):
        return value if isinstance(value, str) else json.dumps(value, default=str)
    if isinstance(dtype, BooleanType):
        if isinstance(value, bool):
            return value
        if str(value).lower() in ("true", "false"):
            return str(value).lower() == "true"
        raise FieldError(field, value, dtype)
    if isinstance(dtype, (LongType, DoubleType)):
        try:
            number = float(value) if isinstance(dtype, DoubleType) else (
                int(value) if isinstance(value, (int, str)) else int(value) if float(value).is_integer() else None)
        except (TypeError, ValueError, OverflowError):
            number = None
        if number is None or (isinstance(dtype, LongType) and not -(1 << 63) <= number < 1 << 63):
            raise FieldError(field, value, dtype)
        return number
    return value


def parse_literal_lines(lines: DataFrame, schema: StructType, column: str = "value",
                        partitions: int | None = None, ordinal: str | None = None) -> DataFrame:
    """``line, json, field, error`` for every input line: json for a good line, the other
    three for a bad one (field null where the line does not parse at all). ``ordinal`` names
    a column of line numbers to carry along (see ``text_lines``).

    The parse is CPU-bound per line. Text-file scans already split the input evenly;
    lines coming out of an aggregation may sit in a few byte-sized partitions, so
    ``partitions`` spreads them round-robin over that many tasks first."""
    ship_package(lines.sparkSession)

    def to_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for line in pdf["line"].tolist():
                try:
                    obj = literal(line) if line is not None else None
                    if not isinstance(obj, dict):
                        raise ValueError("line is not a dict literal")
                    out.append((None, json.dumps(convert(obj, schema, "")), None, None))
                except FieldError as e:
                    out.append((line, None, e.field, str(e)))
                except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError) as e:
                    out.append((line, None, None, f"{type(e).__name__}: {e}"))
            done = pd.DataFrame(out, columns=["line", "json", "field", "error"])
            if ordinal:
                done[ordinal] = pdf[ordinal].to_numpy()
            yield done

    src = lines.select(F.col(column).cast("string").alias("line"), *([F.col(ordinal).cast("long").alias(ordinal)] if ordinal else []))
    if partitions:
        src = src.repartition(partitions)
    return src.mapInPandas(to_json, _PARSED + (f", {ordinal} long" if ordinal else ""))


def ingest_literal_lines(lines: DataFrame, schema: StructType, column: str = "value",
                         partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Return ``(rows, quarantine)``: typed rows for good lines, and ``line, field,
    error`` for bad ones. Consume both from a written table (see ``plans.etl``) so the
    Python pass runs once."""
    return split_parsed(parse_literal_lines(lines, schema, column, partitions), schema)


def split_parsed(parsed: DataFrame, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """``parse_literal_lines`` output -> typed rows (JVM-side ``from_json``) and quarantine,
    both with the lines' ordinal where it was carried."""
    carried = [c for c in parsed.columns if c not in ("line", "json", "field", "error")]
    rows = parsed.where(F.col("error").isNull()).select(F.from_json("json", schema).alias("_r"), *carried).select("_r.*", *carried)
    quarantine = parsed.where(F.col("error").isNotNull()).select("line", "field", "error", *carried)
    return rows, quarantine


def read_literal_lines(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Text files of literal lines -> ``(rows, quarantine)``, with ``line_no``."""
    return split_parsed(parse_literal_lines(read_numbered_lines(spark, path), schema, ordinal="line_no"), schema)
