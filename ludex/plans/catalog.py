"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator of the
inventory, run over the test-table bindings. Array results are shown as ``|``-joined
text so every engine renders them alike; doubles from sums are rounded (6 places, or 2
for values that are sums of 2-decimal amounts).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ludex import schemas
from ludex.functions import clean
from ludex.operators import joins, profile, recommend, sentiment
from ludex.plans import questions as K
from ludex.plans import tables as T
from ludex.sources import bindings as B
from ludex.session import scratch_path
from ludex.sources import json_lines, literal_lines, parquet

# Arguments of the single-answer questions (values present in every scale of the test data).
DEVELOPER = "Brand#2"
USER = 516
GENRE = "ring"
YEAR = 1998
ITEM = "small ring 0"

# Demo lexicon for the sentiment job: the test text is invented prose, so a real word
# list would barely match; these frequent words stand in.
DEMO_LEXICON = [("that", 1.9), ("for", 0.8), ("was", -1.5), ("and", -0.4),
                ("good", 1.9), ("bad", -2.5), ("great", 3.1), ("not", 0.0),
                ("like", 1.5), (":)", 2.0), ("très", 0.7), ("no", -1.2)]
# Demo phrases, made of the same words: idioms, a booster, a neutral one; some overlap.
DEMO_PHRASES = [("for that", "idiom", 1.1), ("that was", "booster", 0.293), ("for the was", "idiom", -0.9), ("and that", "neutral", None),
                ("that and", "idiom", -1.3), ("but great", "idiom", 2.4)]


class Bound:
    """Lazily built derived tables over one test-data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, edge: bool = False):
        self.spark, self.d, self.edge = spark, sf_dir, edge

    @cached_property
    def games_raw(self): return (B.games_edge if self.edge else B.games_raw)(self.spark, self.d)
    @cached_property
    def games(self): return T.build_games(self.games_raw)
    @cached_property
    def prices(self): return T.build_prices(self.games)
    @cached_property
    def genres(self): return T.build_genres(self.games)
    @cached_property
    def genres_x(self): return T.explode_genres(self.genres)
    @cached_property
    def devs(self): return T.derive_game_dev(self.games)
    @cached_property
    def user_items(self): return B.user_items(self.spark, self.d)
    @cached_property
    def item_counts(self): return B.user_item_count(self.spark, self.d)
    @cached_property
    def reviews(self): return B.reviews(self.spark, self.d)
    @cached_property
    def lexicon(self):
        return self.spark.createDataFrame(DEMO_LEXICON, schemas.LEXICON)
    @cached_property
    def phrases(self):
        return self.spark.createDataFrame(DEMO_PHRASES, sentiment.PHRASES)


def _joined(c: str) -> F.Column:
    return F.array_join(F.col(c), "|").alias(c)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# =========================================================================== sources

@query
def ingest_json_lines(spark, d):
    """A1: JSON text parsed strictly with a declared schema."""
    ev = B.table(spark, d, "events").select("event_id", F.col("props").alias("value"))
    return json_lines.parse_json_lines(ev, schemas.EVENT_PROPS, keep=("event_id",))


@query
def json_flatten(spark, d):
    """A2: nested object -> dotted leaf columns."""
    ev = B.table(spark, d, "events")
    nested = ev.select("event_id", F.from_json("props", schemas.EVENT_PROPS).alias("props"))
    return json_lines.flatten(nested)


@query
def ingest_literal_lines(spark, d):
    """A3: Python-literal lines -> typed nested rows (quarantine empty here), exploded."""
    lines = B.library_literal_lines(spark, d)   # built by an aggregation: spread before parsing
    rows, _bad = literal_lines.ingest_literal_lines(lines, schemas.LIBRARY,
                                                    partitions=4 * spark.sparkContext.defaultParallelism)
    return (rows.select("user_id", F.explode_outer("items").alias("it"))
                .select("user_id", F.col("it.item_id").alias("item_id"),
                        F.col("it.playtime_forever").alias("playtime_forever")))


@query
def ingest_json_files(spark, d):
    """A1: the catalogue written as JSON text files and read back strictly, unknown keys kept."""
    g = B.games_raw(spark, d).withColumn("size", F.col("id") % 50)
    lines = g.select(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) if c == "id" else F.col(c) for c in g.columns])).alias("value"))
    path = scratch_path(spark, "catalogue-json")
    lines.repartition(4).write.text(path)
    got = json_lines.ingest_with_rest(spark, path, schemas.CATALOGUE, schemas.OTHER)
    return got.select("id", "app_name", "developer", "price", "release_date", _joined("genres"),
                      F.get(F.map_values(schemas.OTHER), F.lit(0)).alias("size"))


@query
def first_item_count(spark, d):
    """A3 + T7: library lines in text files, several per user; each user's first line decides."""
    path = scratch_path(spark, "library-lines")
    lines = B.library_literal_lines(spark, d, keep=("o_orderkey",))
    lines.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").select("value").write.text(path)
    rows, _bad = literal_lines.read_literal_lines(spark, path, schemas.LIBRARY)
    return T.first_item_count(T.split_user_items(rows)[1])


@query
def quarantine_literal_lines(spark, d):
    """A3: lines that do not parse, or hold a value of another type, with the field."""
    _rows, bad = literal_lines.ingest_literal_lines(B.bad_literal_lines(spark, d), schemas.LIBRARY)
    return bad.select("line", "field")


@query
def full_scan(spark, d):
    """A4: full Parquet scan, every column."""
    return parquet.read_table(spark, f"{d}/part.parquet")


@query
def scan_projected(spark, d):
    """A4: Parquet scan of a narrow projection (only the two columns are read)."""
    p = parquet.read_table(spark, f"{d}/part.parquet", ["p_partkey", "p_brand"])
    return p.select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("developer"))


@query
def parquet_roundtrip(spark, d):
    """A5: write a derived table to the shared folder and read it back."""
    return parquet.roundtrip(Bound(spark, d).devs, "devs")


# =========================================================================== projection / cast

@query
def derive_game_dev(spark, d):
    return Bound(spark, d).devs


@query
def numeric_coerce(spark, d):
    g = Bound(spark, d, edge=True).games_raw
    return g.select(F.col("id").alias("item_id"), clean.numeric_coerce(F.col("price")).alias("price_num"))


@query
def playtime_hours(spark, d):
    return Bound(spark, d).user_items


@query
def percent_label(spark, d):
    r = Bound(spark, d).reviews
    return r.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(clean.percent_label(F.avg(F.col("recommend").cast("double"))).alias("recommend_pct"))


# =========================================================================== filters

@query
def drop_all_null(spark, d):
    """Rows with any value in any column."""
    g = Bound(spark, d, edge=True).games_raw.na.drop(how="all")
    return g.select("id", "app_name", "developer", "publisher", _joined("genres"), "price", "release_date")


@query
def drop_null_subset(spark, d):
    return Bound(spark, d, edge=True).prices


@query
def filter_user(spark, d):
    u = Bound(spark, d).user_items
    return u.where(F.col("user_id") == F.lit(USER))


@query
def filter_ci(spark, d):
    g = Bound(spark, d).games
    return g.where(F.col("developer_lc") == F.lit(DEVELOPER.lower())).select("item_id", "developer", "price")


@query
def filter_positive_year(spark, d):
    r = Bound(spark, d).reviews
    return r.where((F.col("recommend") == F.lit(True)) & (F.col("sentiment") == 2)
                   & (F.col("review_year") == YEAR)).select("user_id", "item_id")


# =========================================================================== cleaning

@query
def parse_mixed_dates(spark, d):
    g = Bound(spark, d, edge=True).games_raw
    return g.select(F.col("id").alias("item_id"), F.col("release_date").alias("release_text"),
                    clean.parse_mixed_dates(F.col("release_date")).alias("release_date"))


@query
def normalize_price(spark, d):
    g = Bound(spark, d, edge=True).games_raw
    return g.select(F.col("id").alias("item_id"), F.col("price").alias("price_text"),
                    clean.normalize_price(F.col("price")).alias("price"))


@query
def release_year(spark, d):
    return Bound(spark, d, edge=True).games.select("item_id", "release_year")


@query
def strip_posted(spark, d):
    lines = B.review_lines(spark, d)
    r = lines.select("user_id", F.explode("reviews").alias("r"))
    return r.select("user_id", F.col("r.item_id").alias("item_id"),
                    clean.strip_prefix(F.col("r.posted")).alias("posted_text"))


@query
def unparsed_values(spark, d):
    return T.unparsed_prices(Bound(spark, d, edge=True).games_raw)


@query
def date_null_report(spark, d):
    return T.date_null_report(Bound(spark, d, edge=True).games_raw)


# =========================================================================== arrays

@query
def array_replace(spark, d):
    g = B.entity_genres(spark, d)
    return g.select("item_id", F.array_join(clean.replace_in_array(F.col("genres")), "|").alias("genres"))


@query
def explode_genres(spark, d):
    return Bound(spark, d).genres_x


@query
def explode_user_items(spark, d):
    nested, _ = T.split_user_items(B.library_lines(spark, d))
    return T.explode_user_items(nested)


@query
def distinct_price_per_item(spark, d):
    return Bound(spark, d, edge=True).prices.where(F.col("item_id").isNotNull()).select("item_id", "price").distinct()


# =========================================================================== derived tables

@query
def build_games(spark, d):
    g = Bound(spark, d, edge=True).games
    return g.select("item_id", "app_name", "developer", "developer_lc", "publisher", _joined("genres"),
                    "price", "release_date", "release_year")


@query
def build_prices(spark, d):
    return Bound(spark, d, edge=True).prices


@query
def build_genres(spark, d):
    return Bound(spark, d).genres.select("item_id", _joined("genres"), "release_year")


@query
def build_user_item_count(spark, d):
    _, counts = T.split_user_items(B.library_lines(spark, d))
    return counts


@query
def build_user_items(spark, d):
    """Nested libraries, one row per line; items as sorted text to compare them."""
    nested, _ = T.split_user_items(B.library_lines(spark, d))
    item = F.transform("items", lambda i: F.concat(F.coalesce(i["item_id"].cast("string"), F.lit("-")), F.lit(":"),
                                                   F.coalesce(i["playtime_forever"].cast("string"), F.lit("-"))))
    return nested.select("user_id", F.array_join(F.array_sort(item), "|").alias("items"))


@query
def user_reviews_content(spark, d):
    """T9 with its nested content, as sorted text to compare it."""
    r = T.build_user_reviews(B.review_lines(spark, d))
    one = F.transform("reviews", lambda x: F.concat_ws("~", x["review"], x["recommend"].cast("string"),
                                                       x["item_id"].cast("string"), x["posted"]))
    return r.select("user_id", "user_url", F.array_join(F.array_sort(one), "|").alias("reviews"))


@query
def build_user_reviews(spark, d):
    r = T.build_user_reviews(B.review_lines(spark, d))
    return r.select("user_id", "user_url", F.size("reviews").alias("review_count"))


@query
def build_reviews_pre(spark, d):
    return T.explode_reviews(T.build_user_reviews(B.review_lines(spark, d)))


@query
def derive_reviews(spark, d):
    b = Bound(spark, d)
    pre = T.explode_reviews(T.build_user_reviews(B.review_lines(spark, d)))
    return T.derive_reviews(pre, b.lexicon, b.phrases)


# =========================================================================== joins

@query
def join_review_names(spark, d):
    b = Bound(spark, d)
    names = b.games.select("item_id", "app_name")
    return b.reviews.select("user_id", "item_id", "recommend", "sentiment").join(names, "item_id", "left")


@query
def join_item_prices(spark, d):
    b = Bound(spark, d)
    return joins.left_join(b.user_items.select("user_id", "item_id"), b.prices, "item_id")


@query
def library_prices_null_safe(spark, d):
    """F2 as the source merges: rows without an item meet the prices of rows without id."""
    b = Bound(spark, d, edge=True)
    prices = b.games_raw.select(F.col("id").alias("item_id"), clean.normalize_price(F.col("price")).alias("price")).where("price is not null")
    # Rows of an item meet the same prices, so they are counted first and the counts joined:
    # rows without an item times prices without id would grow with the square of the tables.
    owned = b.user_items.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n"))
    joined = joins.left_join(owned, prices, "item_id", null_safe=True)
    return joined.groupBy("item_id").agg(F.sum("_n").alias("rows"), F.round(F.sum(F.col("_n") * F.col("price")), 2).alias("price_sum"))


@query
def join_genre_playtime(spark, d):
    b = Bound(spark, d)
    return K.genre_playtime(b.genres_x, b.user_items)


@query
def join_dev_counts(spark, d):
    b = Bound(spark, d)
    per_item = b.reviews.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n"))
    return (b.devs.select("item_id", "developer").join(per_item, "item_id", "left")
                  .select("item_id", "developer", F.coalesce("_n", F.lit(0)).alias("reviews")))


# =========================================================================== profiling

@query
def group_size(spark, d):
    return profile.group_size(Bound(spark, d).reviews, ["item_id"])


@query
def playtime_per_user(spark, d):
    s = profile.sum_per_group(Bound(spark, d).user_items, "user_id", "playtime", "hours")
    return s.select("user_id", F.round("hours", 2).alias("hours"))


@query
def reviews_per_date(spark, d):
    r = Bound(spark, d).reviews.na.drop(how="any")
    return r.groupBy("review_date").agg(F.count("recommend").alias("reviews"))


@query
def sentiment_counts_per_item(spark, d):
    r = Bound(spark, d).reviews.where(F.col("item_id").isNotNull())
    return r.groupBy("item_id").agg(F.count_if(F.col("sentiment") == 2).alias("positive"),
                                    F.count_if(F.col("sentiment") == 0).alias("negative"))


@query
def value_percentages(spark, d):
    return profile.value_percentages(Bound(spark, d).genres_x, "genre")


@query
def release_year_first20(spark, d):
    """The frequency table of the release year, first 20."""
    t = profile.value_percentages(Bound(spark, d).games, "release_year")
    return profile.ranked_top(t, [F.col("rows").desc(), F.col("release_year").asc()], 20)


@query
def sentiment_frequency(spark, d):
    return profile.value_percentages(Bound(spark, d).reviews, "sentiment")


@query
def recommend_frequency(spark, d):
    return profile.value_percentages(Bound(spark, d).reviews, "recommend")


@query
def null_profile(spark, d):
    g = Bound(spark, d, edge=True).games.select("item_id", "app_name", "developer", "publisher", "genres",
                                     "price", "release_date", "release_year")
    return profile.null_profile(g)


@query
def sentiment_recommend_crosstab(spark, d):
    return profile.combination_counts(Bound(spark, d).reviews, "sentiment", "recommend")


@query
def distinct_count_with_null(spark, d):
    return profile.distinct_count_with_null(Bound(spark, d).reviews, "review_year")


@query
def distinct_years(spark, d):
    return Bound(spark, d).reviews.select("review_year").distinct()


@query
def describe_price(spark, d):
    prices = Bound(spark, d, edge=True).prices.where(F.col("item_id").isNotNull())
    return profile.describe(prices.select("item_id", "price").distinct(), "price")


@query
def describe_playtime(spark, d):
    return profile.describe(Bound(spark, d).user_items, "playtime")


@query
def describe_items_count(spark, d):
    return profile.describe(Bound(spark, d).item_counts, "items_count")


@query
def top_publishers(spark, d):
    return profile.top_values(Bound(spark, d).games, "publisher", 5)


@query
def top_developers(spark, d):
    return profile.top_values(Bound(spark, d).games, "developer", 5)


@query
def genre_counts(spark, d):
    return profile.group_size(Bound(spark, d).genres_x, ["genre"])


@query
def games_per_year(spark, d):
    c = profile.group_size(Bound(spark, d).genres_x, ["release_year"])
    return c.select("release_year", clean.year_label(F.col("release_year")).alias("year_label"), "rows")


@query
def sort_nulls_last(spark, d):
    return profile.sorted_positions(Bound(spark, d).reviews, "review_year")


@query
def top20_playtime(spark, d):
    s = profile.sum_per_group(Bound(spark, d).user_items, "user_id", "playtime", "hours") \
               .select("user_id", F.round("hours", 2).alias("hours"))
    return profile.ranked_top(s, [F.col("hours").desc(), F.col("user_id").asc()], 20)


@query
def top20_items_count(spark, d):
    c = Bound(spark, d).item_counts
    return profile.ranked_top(c, [F.col("items_count").desc(), F.col("user_id").asc()], 20)


# =========================================================================== sentiment

@query
def sentiment_compound(spark, d):
    b = Bound(spark, d)
    s = sentiment.compound_scores(B.review_texts(spark, d), "doc_id", "text", b.lexicon, phrases=b.phrases)
    return s.select("doc_id", (F.round("compound", 6) + F.lit(0.0)).alias("compound"))   # -0.0 -> 0.0


@query
def sentiment_class(spark, d):
    b = Bound(spark, d)
    return sentiment.score_texts(B.review_texts(spark, d), b.lexicon, phrases=b.phrases).select("doc_id", "sentiment")


# =========================================================================== recommender

@query
def recommend_score(spark, d):
    r = Bound(spark, d).reviews
    return r.select("user_id", "item_id", recommend.recommend_score(F.col("recommend"), F.col("sentiment")).alias("score"))


@query
def user_item_scores(spark, d):
    b = Bound(spark, d)
    s = recommend.user_item_scores(b.reviews, b.games)
    return s.select("user_id", "item", F.round("score", 6).alias("score"))


@query
def normalize_scores(spark, d):
    b = Bound(spark, d)
    v = recommend.normalize_scores(recommend.user_item_scores(b.reviews, b.games))
    return v.select("user_id", "item", (F.round("v", 6) + F.lit(0.0)).alias("v"))


@query
def item_similarity(spark, d):
    b = Bound(spark, d)
    return recommend.item_similarity(b.reviews, b.games)


@query
def similar_items_topk(spark, d):
    b = Bound(spark, d)
    return K.similar_items_topk(b.reviews, b.games, 5)


@query
def recommend_item(spark, d):
    b = Bound(spark, d)
    return K.recommend_item(b.reviews, b.games, ITEM, 5)


# =========================================================================== questions

@query
def developer_free_share(spark, d):
    return K.developer_free_share(Bound(spark, d).games, DEVELOPER)


@query
def developer_free_share_all(spark, d):
    return K.developer_free_share_all(Bound(spark, d).games)


@query
def user_data(spark, d):
    b = Bound(spark, d)
    return K.user_data(b.user_items, b.prices, b.reviews, b.item_counts, USER)


@query
def user_data_all(spark, d):
    b = Bound(spark, d)
    return K.user_data_all(b.user_items, b.prices, b.reviews, b.item_counts)


@query
def user_for_genre(spark, d):
    b = Bound(spark, d)
    return K.user_for_genre(b.genres_x, b.user_items, GENRE)


@query
def user_for_genre_all(spark, d):
    b = Bound(spark, d)
    return K.user_for_genre_all(b.genres_x, b.user_items)


@query
def best_developer_year(spark, d):
    b = Bound(spark, d)
    return K.best_developer_year(b.reviews, b.devs, YEAR)


@query
def best_developer_all_years(spark, d):
    b = Bound(spark, d)
    return K.best_developer_all_years(b.reviews, b.devs)


@query
def developer_reviews_analysis(spark, d):
    b = Bound(spark, d)
    return K.developer_reviews_analysis(b.reviews, b.devs, DEVELOPER)


@query
def developer_reviews_all(spark, d):
    b = Bound(spark, d)
    return K.developer_reviews_all(b.reviews, b.devs)
