"""Declared schemas of the raw inputs (nothing is inferred)."""

from pyspark.sql.types import (ArrayType, BooleanType, LongType, StringType, StructField,
                               StructType, DoubleType)

CATALOGUE = StructType([
    StructField("id", StringType()),
    StructField("app_name", StringType()),
    StructField("developer", StringType()),
    StructField("publisher", StringType()),
    StructField("genres", ArrayType(StringType())),
    StructField("price", StringType()),          # text or number: numbers arrive as text
    StructField("release_date", StringType()),
])
# Every other key of a catalogue line, as text (T1 keeps all columns).
OTHER = "other_columns"

# Keys not declared here (e.g. other ids in the raw lines) are ignored on read.
LIBRARY = StructType([
    StructField("user_id", StringType()),
    StructField("user_url", StringType()),
    StructField("items_count", LongType()),
    StructField("items", ArrayType(StructType([
        StructField("item_id", StringType()),
        StructField("playtime_forever", LongType()),
    ]))),
])

REVIEWS = StructType([
    StructField("user_id", StringType()),
    StructField("user_url", StringType()),
    StructField("reviews", ArrayType(StructType([
        StructField("review", StringType()),
        StructField("recommend", BooleanType()),
        StructField("item_id", StringType()),
        StructField("posted", StringType()),
    ]))),
])

LEXICON = StructType([
    StructField("token", StringType()),
    StructField("valence", DoubleType()),
])

EVENT_PROPS = StructType([StructField("k", LongType())])
