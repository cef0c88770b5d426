"""Derived-table jobs T1-T11: raw catalogue, libraries and reviews -> clean flat tables.

Every job is a pure ``DataFrame -> DataFrame`` function; ``plans.etl`` writes them.
Nested arrays are flattened with ``explode_outer`` (an empty or null list keeps one row
with nulls, like the source project) and struct fields are lifted with plain field
access, which is null-safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ludex.functions import clean
from ludex.operators import sentiment


# --------------------------------------------------------------------------- catalogue

ORDINAL = "line_no"             # line number of the input that a row comes from


def build_games(raw: DataFrame) -> DataFrame:
    """Drop all-null rows, parse the release date, year (0 = unknown), rename ``id``,
    clean the price. Adds ``developer_lc`` so case-insensitive lookups push down."""
    df = raw.na.drop(how="all").withColumnRenamed("id", "item_id")
    df = df.withColumns({
        "release_date": clean.parse_mixed_dates(F.col("release_date")),
        "price": clean.normalize_price(F.col("price")),
        "developer_lc": F.lower(F.col("developer")),
    })
    return df.withColumn("release_year", clean.release_year(F.col("release_date")))


def unparsed_prices(raw: DataFrame) -> DataFrame:
    """Distinct price texts the cleaning rules cannot read, with their counts.
    Empty is the acceptance gate for ``build_games``."""
    return (raw.where(clean.unparsed_price(F.col("price")))
               .groupBy(F.col("price").alias("price_text")).agg(F.count(F.lit(1)).alias("rows")))


def date_null_report(raw: DataFrame) -> DataFrame:
    """How many release dates are null after parsing: ``rows, null_dates, null_pct``."""
    d = clean.parse_mixed_dates(F.col("release_date"))
    n = raw.agg(F.count(F.lit(1)).alias("rows"), F.count_if(d.isNull()).alias("null_dates"))
    return n.withColumn("null_pct", clean.round2(F.lit(100.0) * F.col("null_dates") / F.col("rows")))


def build_prices(games: DataFrame) -> DataFrame:
    """``item_id, price`` with a known price."""
    return games.select("item_id", "price").na.drop(subset=["price"])


def build_genres(games: DataFrame) -> DataFrame:
    """``item_id, genres, release_year`` for items with a genre list; the HTML entity
    inside genre names is replaced."""
    return (games.select("item_id", "genres", "release_year").na.drop(subset=["genres"])
                 .withColumn("genres", clean.replace_in_array(F.col("genres"))))


def explode_genres(genres: DataFrame) -> DataFrame:
    """T4: one row per (item, genre); an empty list keeps one null-genre row."""
    return (genres.select("item_id", F.explode_outer("genres").alias("genre"), "release_year")
                  .withColumn("genre_lc", F.lower(F.col("genre"))))


def derive_game_dev(games: DataFrame) -> DataFrame:
    """T5: ``item_id, developer, developer_lc, release_year`` for items with a developer."""
    return games.select("item_id", "developer", "developer_lc", "release_year").na.drop(subset=["developer"])


# --------------------------------------------------------------------------- libraries

def split_user_items(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """T6 and T7 from library lines: (``user_id, items``) and (``user_id, items_count``), the
    latter with the line's ordinal where the ingest carried one."""
    return lines.select("user_id", "items"), lines.select("user_id", "items_count", *[c for c in lines.columns if c == ORDINAL])


def first_item_count(item_counts: DataFrame) -> DataFrame:
    """``user_id, items_count`` once per user: the first line's count. A table without ordinals
    has one row a user; if not, the largest count."""
    count = F.min_by("items_count", ORDINAL) if ORDINAL in item_counts.columns else F.max("items_count")
    return item_counts.groupBy("user_id").agg(count.alias("items_count"))


def explode_user_items(nested: DataFrame) -> DataFrame:
    """One row per owned item, ``user_id, item_id, playtime`` (hours, 2 decimals)."""
    it = F.explode_outer("items").alias("it")
    return (nested.select("user_id", it)
                  .select("user_id", F.col("it.item_id").alias("item_id"),
                          clean.minutes_to_hours(F.col("it.playtime_forever")).alias("playtime")))


# --------------------------------------------------------------------------- reviews

def build_user_reviews(lines: DataFrame) -> DataFrame:
    """Review lines with all-null rows dropped."""
    return lines.na.drop(how="all")


def explode_reviews(nested: DataFrame) -> DataFrame:
    """One row per review. Rows without review text are dropped before the other
    fields are read; ``Posted `` is stripped and the date parsed; year stays null when
    the date is unknown."""
    r = nested.select("user_id", "user_url", F.explode_outer("reviews").alias("r"))
    r = r.where(F.col("r.review").isNotNull())
    d = clean.parse_mixed_dates(clean.strip_prefix(F.col("r.posted")))
    flat = r.select("user_id", "user_url",
                    F.col("r.review").alias("review"),
                    F.col("r.recommend").alias("recommend"),
                    F.col("r.item_id").alias("item_id"),
                    d.alias("review_date"))
    return flat.withColumn("review_year", F.year("review_date"))


def derive_reviews(pre: DataFrame, lexicon: DataFrame, phrases: DataFrame | None = None) -> DataFrame:
    """Reviews with a sentiment class (0/1/2) from the review text (null text -> 1);
    text and URL dropped."""
    return sentiment.classify_rows(pre, "review", lexicon, phrases=phrases).drop("user_url")
