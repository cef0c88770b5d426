"""Strict JSON-lines ingest (A1) and flattening of nested objects to dotted columns (A2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ingest_json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read JSON lines with a declared schema; one malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def ingest_with_rest(spark: SparkSession, path: str, schema: StructType, rest: str) -> DataFrame:
    """The same, with every key the schema does not declare kept in one map column
    ``rest`` (values as text, null where a line has none)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    names = F.array(*[F.lit(f.name) for f in schema.fields])
    every = F.from_json(F.col("value"), "map<string,string>", {"mode": "FAILFAST"})
    other = F.map_filter(every, lambda k, _: ~F.array_contains(names, k))
    parsed = lines.select(F.from_json(F.col("value"), schema, {"mode": "FAILFAST"}).alias("_r"), other.alias("_o"))
    return parsed.select("_r.*", F.when(F.size("_o") > 0, F.col("_o")).alias(rest))


def parse_json_lines(lines: DataFrame, schema: StructType, column: str = "value",
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """The same strict parse for lines already in a string column (e.g. a text scan or a
    JSON column of a table): the object's fields become top-level columns."""
    parsed = F.from_json(F.col(column), schema, {"mode": "FAILFAST"}).alias("_r")
    return lines.select(*keep, parsed).select(*keep, "_r.*")


def _leaves(dtype: StructType, path: list[str]) -> list[tuple[list[str], object]]:
    out = []
    for f in dtype.fields:
        p = path + [f.name]
        if isinstance(f.dataType, StructType):
            out.extend(_leaves(f.dataType, p))
        else:
            out.append((p, f.dataType))
    return out


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Expand nested struct columns into one column per leaf named ``a.b.c``; arrays are
    kept as they are (like a JSON normaliser). Pure projection, generated from the schema."""
    cols: list[Column] = []
    for p, _ in _leaves(df.schema, []):
        ref = F.col(".".join(f"`{x}`" for x in p))
        cols.append(ref.alias(sep.join(p)))
    return df.select(*cols)
