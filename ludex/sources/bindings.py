"""Bindings: the test tables under ``/root/testdata/sf*`` viewed as the store's raw inputs.

The store's own files (catalogue, libraries, reviews) are not available, so these plain
projections stand in for them (see FIXTURES.md §2). Every binding is lazy and grows with
the tables it reads: ``part`` -> catalogue, ``lineitem ⋈ orders`` -> libraries and reviews.

Nested forms are nested per order (at most seven lines), never per user, so building
them never collects an unbounded group.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ludex.functions import clean

_EPOCH = _dt.date(1995, 1, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --------------------------------------------------------------------------- catalogue

def games_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw catalogue rows: ``id, app_name, developer, publisher, genres, price, release_date``
    with price and date as uncleaned text, as in the store's JSON lines."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    size10 = F.col("p_size") % 10
    day = F.date_add(F.lit(_EPOCH), key.cast("int"))
    k6 = key % 6
    price = (F.when(size10 == 0, F.lit(None).cast("string"))
             .when(size10 == 1, F.lit("Install Now"))
             .when(size10 == 2, F.lit("Third-party"))
             .when(size10 == 3, F.lit("Starting at $499.00"))
             .when(size10 == 4, F.lit("Starting at $449.00"))
             .when(size10 == 5, F.lit("Free To Play"))
             .otherwise(F.col("p_retailprice").cast("string")))
    release = (F.when(k6 == 0, F.date_format(day, "yyyy-MM-dd"))
               .when(k6 == 1, F.date_format(day, "MMM yyyy"))
               .when(k6 == 2, F.date_format(day, "yyyy"))
               .when(k6 == 3, F.lit("Soon.."))
               .when(k6 == 4, F.lit(None).cast("string"))
               .otherwise(F.date_format(day, "MMMM d, yyyy")))
    genres = F.when(F.col("p_size") % 7 == 0, F.lit(None).cast("array<string>")) \
              .otherwise(F.split(F.col("p_name"), " "))
    return p.select(
        key.alias("id"),
        F.concat(F.col("p_name"), F.lit(" "), key.cast("string")).alias("app_name"),
        F.when(size10 == 9, F.lit(None).cast("string")).otherwise(F.col("p_brand")).alias("developer"),
        F.col("p_type").alias("publisher"),
        genres.alias("genres"),
        price.alias("price"),
        release.alias("release_date"),
    )


def _spelled_date(day: Column, kind: Column) -> Column:
    """One of 24 spellings that raw files hold; two of them are no date."""
    ordinal = F.concat(F.dayofmonth(day).cast("string"), F.when(F.dayofmonth(day).isin(1, 21, 31), "st").when(F.dayofmonth(day).isin(2, 22), "nd")
                       .when(F.dayofmonth(day).isin(3, 23), "rd").otherwise("th"))
    f = lambda pattern: F.date_format(day, pattern)
    spelled = [f("yyyy-MM-dd"), f("MMM yyyy"), f("yyyy"), F.lit("Soon.."), F.lit(None).cast("string"), f("MMMM d, yyyy"), f("d MMM yyyy"),
               f("MMMM yyyy"), f("EEE, d MMM yyyy"), f("M/d/yyyy"), f("MM/dd/yyyy"), F.concat(ordinal, F.lit(" "), f("MMMM yyyy")),
               f("yyyy.MM.dd"), f("yyyyMMdd"), f("MMM-dd-yyyy"), f("dd-MMM-yyyy"), f("yyyy MMM d"), f("yyyy-MM-dd'T12:30:00+02:00'"),
               f("MMM d, yyyy '12:00 PM'"), f("EEEE, MMMM d yyyy"), F.upper(f("d MMMM, yyyy.")), F.concat(f("MMMM "), ordinal, f(", yyyy")),
               f("yyyy/M/d"), f("'Early' yyyy")]
    out = F.when(kind == 0, spelled[0])
    for i, s in enumerate(spelled[1:], 1):
        out = out.when(kind == i, s)
    return out


def games_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same catalogue with more of what raw files hold: rows without id, all-null rows,
    signed, exponent and non-numeric prices, dates in 24 spellings. Input
    of the cleaning queries."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    size10 = F.col("p_size") % 10
    day = F.date_add(F.lit(_EPOCH), key.cast("int"))
    k4 = key % 4
    odd_price = (F.when(k4 == 0, F.lit("-1.5")).when(k4 == 1, F.lit("1E3")).when(k4 == 2, F.lit("1d")).otherwise(F.lit(" 2.5")))
    price = (F.when(size10 == 0, F.lit(None).cast("string"))
             .when(size10 == 1, F.lit("Install Now"))
             .when(size10 == 2, F.lit("Third-party"))
             .when(size10 == 3, F.lit("Starting at $499.00"))
             .when(size10 == 4, F.lit("Starting at $449.00"))
             .when(size10 == 5, F.lit("Free To Play"))
             .when(size10 == 6, odd_price)
             .otherwise(F.col("p_retailprice").cast("string")))
    release = _spelled_date(day, key % 24)
    genres = F.when(F.col("p_size") % 7 == 0, F.lit(None).cast("array<string>")) \
              .otherwise(F.split(F.col("p_name"), " "))
    rows = p.select(
        F.when(key % 500 == 499, F.lit(None)).otherwise(key).alias("id"),        # a few rows without id
        F.concat(F.col("p_name"), F.lit(" "), key.cast("string")).alias("app_name"),
        F.when(size10 == 9, F.lit(None).cast("string")).otherwise(F.col("p_brand")).alias("developer"),
        F.col("p_type").alias("publisher"),
        genres.alias("genres"),
        price.alias("price"),
        release.alias("release_date"),
        (key % 1000 == 998).alias("_blank"),                                     # and all-null rows
    )
    return rows.select(*[F.when(~F.col("_blank"), F.col(c)).alias(c) for c in rows.columns if c != "_blank"])


def entity_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_id, genres`` with one unsplit genre per item whose words are joined by the
    HTML entity, e.g. ``['small&amp;ring']`` (input of the array-replace rule)."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("item_id"),
                    F.array(F.replace(F.col("p_name"), F.lit(" "), F.lit(clean.GENRE_ENTITY))).alias("genres"))


# --------------------------------------------------------------------------- libraries

def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey)


def _item_key(c: str = "l_partkey") -> Column:
    return F.when(F.col("l_linenumber") == 7, F.lit(None).cast("bigint")).otherwise(F.col(c))


def _playtime_minutes() -> Column:
    return F.when(F.col("l_linenumber") == 7, F.lit(None).cast("bigint")) \
            .otherwise((F.col("l_quantity") * 7).cast("bigint"))


def user_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat library rows ``user_id, item_id, playtime`` (hours). Line 7 stands for an
    empty library: its item and playtime are null."""
    j = _order_lines(spark, sf_dir)
    return j.select(F.col("o_custkey").alias("user_id"), _item_key().alias("item_id"),
                    clean.minutes_to_hours(_playtime_minutes()).alias("playtime"))


def user_item_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, items_count``: items owned per user (partial aggregation before the shuffle)."""
    j = _order_lines(spark, sf_dir)
    return j.groupBy(F.col("o_custkey").alias("user_id")).agg(F.count(_item_key()).alias("items_count"))


def library_lines(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Nested library lines, one per order: ``user_id, user_url, items_count,
    items: array<struct<item_id, playtime_forever>>``, and the order's key if kept."""
    j = _order_lines(spark, sf_dir)
    item = F.struct(_item_key().alias("item_id"), _playtime_minutes().alias("playtime_forever"))
    return (j.groupBy("o_orderkey", "o_custkey")
             .agg(F.count(_item_key()).alias("items_count"), F.collect_list(item).alias("items"))
             .select(F.col("o_custkey").alias("user_id"),
                     F.concat(F.lit("profiles/"), F.col("o_custkey").cast("string")).alias("user_url"),
                     "items_count", "items", *keep))


# --------------------------------------------------------------------------- reviews

def _posted() -> Column:
    ship = F.col("l_shipdate")
    body = F.when(F.col("l_linenumber") == 7, F.date_format(ship, "MMMM d")) \
            .otherwise(F.date_format(ship, "MMMM d, yyyy"))
    return F.concat(F.lit(clean.POSTED_PREFIX), body, F.lit("."))


def _recommend() -> Column:
    return F.when(F.col("l_linenumber") == 6, F.lit(None).cast("boolean")) \
            .otherwise(F.col("l_returnflag") != F.lit("R"))


def _review_text() -> Column:
    """Short review text from the line's flags, in words the demo lexicon knows, so the
    sentiment rules (negation, contraction, emoticon, capitals, contrast, "!") all occur."""
    opening = (F.when(F.col("l_linenumber") == 3, F.lit("isn't good"))
                .when(F.col("l_linenumber") == 5, F.lit("I don't like it, très :)"))
                .when(F.col("l_returnflag") == "R", F.lit("bad"))
                .when(F.col("l_returnflag") == "A", F.lit("REALLY good"))
                .otherwise(F.lit("not bad")))
    closing = F.when(F.col("l_linestatus") == "F", F.lit(" but great")).otherwise(F.lit("!"))
    return F.concat(opening, closing)


def review_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested review lines, one per order: ``user_id, user_url, reviews:
    array<struct<review, recommend, item_id, posted>>``. ``posted`` reads like
    ``Posted November 5, 2011.``; line 7 has no year."""
    j = _order_lines(spark, sf_dir)
    rv = F.struct(_review_text().alias("review"), _recommend().alias("recommend"),
                  F.col("l_partkey").alias("item_id"), _posted().alias("posted"))
    return (j.groupBy("o_orderkey", "o_custkey").agg(F.collect_list(rv).alias("reviews"))
             .select(F.col("o_custkey").alias("user_id"),
                     F.concat(F.lit("profiles/"), F.col("o_custkey").cast("string")).alias("user_url"),
                     "reviews"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat reviews with their sentiment class, as the questions read them from the
    written T11 table: ``user_id, item_id, recommend, sentiment, review_date,
    review_year``. The date is the one ``review_lines`` spells out in ``posted`` (null
    where that text has no year); parsing it back is the T10 job (``explode_reviews``)."""
    j = _order_lines(spark, sf_dir)
    d = F.when(F.col("l_linenumber") == 7, F.lit(None).cast("date")).otherwise(F.col("l_shipdate").cast("date"))
    return j.select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        _recommend().alias("recommend"),
        ((F.col("l_orderkey") + F.col("l_linenumber")) % 3).cast("int").alias("sentiment"),
        d.alias("review_date"),
        F.year(d).alias("review_year"),
    )


# --------------------------------------------------------------------------- text

def review_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review-like text: ``doc_id, text`` from ``documents``."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _py_text(c: Column) -> Column:
    """A Python literal for a value rendered as text: ``"…"`` or ``None``."""
    return F.when(c.isNull(), F.lit("None")).otherwise(F.concat(F.lit('"'), c.cast("string"), F.lit('"')))


def _py_int(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("None")).otherwise(c.cast("string"))


def library_literal_lines(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The library lines rendered as Python dict literals in a ``value`` column, like
    ``{'user_id': u'899', 'items_count': 2, 'items': [{'item_id': '1616', ...}]}``."""
    lines = library_lines(spark, sf_dir, keep)
    item_txt = F.transform("items", lambda it: F.concat(
        F.lit("{'item_id': "), _py_text(it["item_id"]),
        F.lit(", 'playtime_forever': "), _py_int(it["playtime_forever"]), F.lit("}")))
    value = F.concat(
        F.lit("{'user_id': u'"), F.col("user_id").cast("string"),
        F.lit("', 'user_url': '"), F.col("user_url"),
        F.lit("', 'items_count': "), F.col("items_count").cast("string"),
        F.lit(", 'items': ["), F.array_join(item_txt, ", "), F.lit("]}"))
    return lines.select(value.alias("value"), *keep)


def bad_literal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library lines per order of which three in five are bad: broken syntax, a number
    that is text, a list that is text."""
    o = table(spark, sf_dir, "orders")
    user, k = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 5
    head = F.concat(F.lit("{'user_id': '"), user, F.lit("', "))
    value = (F.when(k == 1, F.concat(F.lit("{'user_id': u'"), user, F.lit("', broken")))
              .when(k == 2, F.concat(head, F.lit("'items_count': 'many', 'items': []}")))
              .when(k == 3, F.concat(head, F.lit("'items': 'oops'}")))
              .otherwise(F.concat(head, F.lit("'items_count': '3', 'items': [{'item_id': 7, 'playtime_forever': 90.0}]}"))))
    return o.select(value.alias("value"))


def _py_bool(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("None")).when(c, F.lit("True")).otherwise(F.lit("False"))


def review_literal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review lines rendered as Python dict literals in a ``value`` column."""
    lines = review_lines(spark, sf_dir)
    rv_txt = F.transform("reviews", lambda r: F.concat(
        F.lit("{'review': "), _py_text(r["review"]),
        F.lit(", 'recommend': "), _py_bool(r["recommend"]),
        F.lit(", 'item_id': "), _py_text(r["item_id"]),
        F.lit(", 'posted': "), _py_text(r["posted"]), F.lit("}")))
    value = F.concat(
        F.lit("{'user_id': u'"), F.col("user_id").cast("string"),
        F.lit("', 'user_url': '"), F.col("user_url"),
        F.lit("', 'reviews': ["), F.array_join(rv_txt, ", "), F.lit("]}"))
    return lines.select(value.alias("value"))
