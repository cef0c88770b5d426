"""The six questions (K1-K6), each in a batch form (all arguments at once) and a single
form (one argument). The single form filters first so the predicate reaches the scan
(``developer_lc`` / ``genre_lc`` are stored lower-cased for exactly this), and returns
empty or null answers — never an exception — for unknown arguments.

Inputs are the derived tables (``plans.tables``): ``games`` (T1), ``prices`` (T2),
``genres_x`` (T4), ``devs`` (T5), ``user_items`` (T8), ``item_counts`` (T7),
``reviews`` (T11).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ludex.functions import clean
from ludex.operators import joins, recommend
from ludex.operators.profile import ranked_top
from ludex.plans import tables


def _typed(value, df: DataFrame, column: str):
    """A literal of the column's own type (so the comparison pushes down as-is)."""
    return F.lit(value).cast(df.schema[column].dataType)


# --------------------------------------------------------------------------- K1

def developer_free_share_all(games: DataFrame) -> DataFrame:
    """K1 batch: per developer (case-folded) and release year, items and share of free
    items (price 0; an unknown price counts in the total, not as free)."""
    agg = (games.where(F.col("developer_lc").isNotNull())
                .groupBy("developer_lc", "release_year")
                .agg(F.count(F.lit(1)).alias("item_count"),
                     F.count_if(F.col("price") == 0).alias("free_items")))
    return agg.withColumn("free_content", clean.percent_label(F.col("free_items") / F.col("item_count")))


def developer_free_share(games: DataFrame, developer: str) -> DataFrame:
    """K1: ``release_year, item_count, free_items, free_content`` for one developer."""
    return (developer_free_share_all(games.where(F.col("developer_lc") == F.lit(developer.lower())))
            .select("release_year", "item_count", "free_items", "free_content"))


# --------------------------------------------------------------------------- K2

def _user_data(user_items: DataFrame, prices: DataFrame, reviews: DataFrame,
               item_counts: DataFrame, null_safe: bool = False) -> DataFrame:
    owned = joins.left_join(user_items.select("user_id", "item_id"), prices.select("item_id", "price"),
                            "item_id", null_safe)
    spend = owned.groupBy("user_id").agg(F.coalesce(F.sum("price"), F.lit(0.0)).alias("_spend"))
    rate = reviews.groupBy("user_id").agg(F.avg(F.col("recommend").cast("double")).alias("_rate"))
    count = tables.first_item_count(item_counts)     # several lines for one user: the first counts
    j = spend.join(rate, "user_id", "full").join(count, "user_id", "full")
    return j.where(F.col("user_id").isNotNull()).select(
        "user_id",
        F.round(F.coalesce(F.col("_spend"), F.lit(0.0)), 2).alias("money_spent"),
        clean.percent_label(F.col("_rate")).alias("recommend_pct"),
        "items_count")


def user_data_all(user_items: DataFrame, prices: DataFrame, reviews: DataFrame,
                  item_counts: DataFrame, null_safe: bool = False) -> DataFrame:
    """K2 batch: per user money spent (sum of known prices of owned items), share of
    reviews that recommend, and items owned. The three aggregates are each partitioned
    by user and meet in co-partitioned outer joins. ``null_safe`` lets an empty
    library's null item pick up prices of catalogue rows without id, as in the source."""
    return _user_data(user_items, prices, reviews, item_counts, null_safe)


def user_data(user_items: DataFrame, prices: DataFrame, reviews: DataFrame,
              item_counts: DataFrame, user, null_safe: bool = False) -> DataFrame:
    """K2 for one user: always one row; an unknown user gets spend 0 and nulls. The
    per-user result has at most one row, so a global aggregate over it yields exactly
    one row without a join."""
    def one(df):
        return df.where(F.col("user_id") == _typed(user, df, "user_id"))
    res = _user_data(one(user_items), prices, one(reviews), one(item_counts), null_safe)
    return res.agg(F.coalesce(F.max("money_spent"), F.lit(0.0)).alias("money_spent"),
                   F.max("recommend_pct").alias("recommend_pct"),
                   F.max("items_count").alias("items_count")) \
              .select(_typed(user, user_items, "user_id").alias("user_id"),
                      "money_spent", "recommend_pct", "items_count")


# --------------------------------------------------------------------------- K3

def genre_playtime(genres_x: DataFrame, user_items: DataFrame) -> DataFrame:
    """genre items joined to owners with a known playtime:
    ``genre_lc, item_id, release_year, user_id, playtime``."""
    g = genres_x.where(F.col("genre_lc").isNotNull()).select("genre_lc", "item_id", "release_year")
    u = user_items.where(F.col("playtime").isNotNull() & F.col("item_id").isNotNull()) \
                  .select("item_id", "user_id", "playtime")
    return g.join(u, "item_id")


def user_for_genre_all(genres_x: DataFrame, user_items: DataFrame, top_n: int = 1) -> DataFrame:
    """K3 batch: for each genre the ``top_n`` users with most hours in it (ties: lower
    user id) and their hours per release year."""
    j = genre_playtime(genres_x, user_items).where(F.col("user_id").isNotNull())
    per_year = j.groupBy("genre_lc", "user_id", "release_year").agg(F.sum("playtime").alias("_h"))
    per_user = per_year.groupBy("genre_lc", "user_id").agg(F.round(F.sum("_h"), 2).alias("_total"))
    w = Window.partitionBy("genre_lc").orderBy(F.col("_total").desc(), F.col("user_id").asc())
    best = per_user.withColumn("user_rank", F.row_number().over(w)).where(F.col("user_rank") <= top_n)
    return (per_year.join(best, ["genre_lc", "user_id"])
                    .select("genre_lc", "user_rank", "user_id", "release_year",
                            F.round("_h", 2).alias("hours")))


def user_for_genre(genres_x: DataFrame, user_items: DataFrame, genre: str, top_n: int = 1) -> DataFrame:
    """K3: ``user_id, release_year, hours`` of the user with most hours in ``genre``
    (year descending when shown). Unknown genre -> no rows."""
    g = genres_x.where(F.col("genre_lc") == F.lit(genre.lower()))
    res = user_for_genre_all(g, user_items, top_n)
    cols = ["user_rank", "user_id", "release_year", "hours"] if top_n > 1 else ["user_id", "release_year", "hours"]
    return res.select(*cols)


# --------------------------------------------------------------------------- K4

def positive_review_counts(reviews: DataFrame) -> DataFrame:
    """Reviews that recommend and are positive, counted per (year, item)."""
    return (reviews.where((F.col("recommend") == F.lit(True)) & (F.col("sentiment") == 2)
                          & F.col("review_year").isNotNull())
                   .groupBy("review_year", "item_id").agg(F.count(F.lit(1)).alias("n")))


def best_developer_all_years(reviews: DataFrame, devs: DataFrame, k: int = 3) -> DataFrame:
    """K4 batch: per review year the ``k`` developers with most recommending positive
    reviews (ties: developer name); developers with none are not listed."""
    per_dev = (positive_review_counts(reviews).join(devs.select("item_id", "developer"), "item_id")
               .groupBy("review_year", "developer").agg(F.sum("n").alias("positive_reviews")))
    w = Window.partitionBy("review_year").orderBy(F.col("positive_reviews").desc(), F.col("developer").asc())
    return per_dev.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
                  .select("review_year", "rank", "developer", "positive_reviews")


def best_developer_year(reviews: DataFrame, devs: DataFrame, year: int) -> DataFrame:
    """K4 for one year: places 1-3 over *all* developers (a developer without such
    reviews has 0). As in the source, when the second place has 0 all three places are
    null. Always three rows."""
    r = reviews.where(F.col("review_year") == F.lit(year))
    counts = positive_review_counts(r).select("item_id", "n")
    per_dev = (devs.select("item_id", "developer").join(counts, "item_id", "left")
               .groupBy("developer").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("positive_reviews")))
    top = ranked_top(per_dev, [F.col("positive_reviews").desc(), F.col("developer").asc()], 3)
    second = F.max(F.when(F.col("rank") == 2, F.col("positive_reviews"))).over(Window.partitionBy())
    top = top.withColumn("_second", second).where(F.coalesce(F.col("_second"), F.lit(0)) != 0)
    spine = reviews.sparkSession.range(1, 4).select(F.col("id").cast("int").alias("rank"))
    return (spine.join(top, "rank", "left")
                 .select(F.lit(year).alias("review_year"), "rank", "developer", "positive_reviews"))


# --------------------------------------------------------------------------- K5

def developer_reviews_all(reviews: DataFrame, devs: DataFrame) -> DataFrame:
    """K5 batch: per developer spelling, negative (class 0) and positive (class 2) review
    counts. Reviews are aggregated per item before the join."""
    per_item = reviews.groupBy("item_id").agg(F.count_if(F.col("sentiment") == 0).alias("_neg"),
                                              F.count_if(F.col("sentiment") == 2).alias("_pos"))
    return (devs.select("item_id", "developer").join(per_item, "item_id", "left")
                .groupBy("developer")
                .agg(F.coalesce(F.sum("_neg"), F.lit(0)).alias("negative"),
                     F.coalesce(F.sum("_pos"), F.lit(0)).alias("positive")))


def developer_reviews_analysis(reviews: DataFrame, devs: DataFrame, developer: str) -> DataFrame:
    """K5 for one developer: the developer's items first, then only their reviews."""
    d = devs.where(F.col("developer_lc") == F.lit(developer.lower())).select("item_id", "developer")
    j = d.join(reviews.select("item_id", "sentiment"), "item_id", "left")
    return j.groupBy("developer").agg(F.count_if(F.col("sentiment") == 0).alias("negative"),
                                      F.count_if(F.col("sentiment") == 2).alias("positive"))


# --------------------------------------------------------------------------- K6

def recommend_item(reviews: DataFrame, games: DataFrame, item: str, k: int = 5) -> DataFrame:
    """K6: the ``k`` items most similar to ``item`` (by name)."""
    return recommend.similar_to(reviews, games, item, k)


def similar_items_topk(reviews: DataFrame, games: DataFrame, k: int = 5) -> DataFrame:
    """K6 batch: top ``k`` stored partners for every item."""
    return recommend.similar_items_topk(reviews, games, k)
