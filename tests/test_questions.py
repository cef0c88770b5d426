"""The six questions on the sf0.01 bindings against the anchor values in FIXTURES.md, and
their edge cases (unknown arguments, the second-place guard)."""

import pytest
from pyspark.sql import functions as F

from ludex.plans import catalog as C
from ludex.plans import questions as K

SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def b(spark):
    return C.Bound(spark, SF01)


def test_games_null_and_zero_counts(b):
    g = b.games
    r = g.agg(F.count_if(F.col("price").isNull()).alias("pn"), F.count_if(F.col("price") == 0).alias("p0"),
              F.count_if(F.col("release_year") == 0).alias("y0"), F.count_if(F.col("developer").isNull()).alias("dn"),
              F.count_if(F.col("genres").isNull()).alias("gn")).first()
    assert tuple(r) == (201, 594, 666, 210, 282)
    assert b.genres_x.select("genre").distinct().where(F.col("genre").isNotNull()).count() == 16


def test_k1_developer_free_share(b):
    rows = {r.release_year: r for r in K.developer_free_share(b.games, "BRAND#2").collect()}
    assert len(rows) == 7
    assert (rows[0].item_count, rows[0].free_content) == (33, "36.36%")
    assert (rows[1998].item_count, rows[1998].free_content) == (5, "0.0%")
    assert K.developer_free_share(b.games, "nobody").count() == 0


def test_k2_user_data(b):
    r = K.user_data(b.user_items, b.prices, b.reviews, b.item_counts, 516).first()
    assert r.money_spent == 23044.7 and r.recommend_pct == "72.41%"
    unknown = K.user_data(b.user_items, b.prices, b.reviews, b.item_counts, -1).collect()
    assert len(unknown) == 1 and unknown[0].money_spent == 0.0 and unknown[0].recommend_pct is None


def test_k2_batch_agrees_with_single(b):
    one = K.user_data(b.user_items, b.prices, b.reviews, b.item_counts, 516).first()
    batch = K.user_data_all(b.user_items, b.prices, b.reviews, b.item_counts).where(F.col("user_id") == 516).first()
    assert tuple(one) == tuple(batch)


def test_k3_user_for_genre(b):
    rows = K.user_for_genre(b.genres_x, b.user_items, "RING").collect()
    assert {r.user_id for r in rows} == {516}
    assert K.user_for_genre(b.genres_x, b.user_items, "no-such-genre").count() == 0


def test_k4_best_developer_year(b):
    rows = sorted(K.best_developer_year(b.reviews, b.devs, 1998).collect(), key=lambda r: r["rank"])
    assert [(r.developer, r.positive_reviews) for r in rows] == [("Brand#25", 77), ("Brand#17", 70), ("Brand#8", 65)]
    empty = K.best_developer_year(b.reviews, b.devs, 1900).collect()
    assert len(empty) == 3 and all(r.developer is None for r in empty)


def test_k4_second_place_guard(spark):
    reviews = spark.createDataFrame([(1, True, 2, 2012), (1, True, 2, 2012)],
                                    "item_id long, recommend boolean, sentiment int, review_year int")
    devs = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "item_id long, developer string")
    rows = K.best_developer_year(reviews, devs, 2012).collect()
    assert len(rows) == 3 and all(r.developer is None for r in rows)
    batch = K.best_developer_all_years(reviews, devs).collect()
    assert [(r.developer, r.positive_reviews) for r in batch] == [("A", 2)]


def test_k5_developer_reviews(b):
    r = K.developer_reviews_analysis(b.reviews, b.devs, "brand#2").collect()
    assert [(x.developer, x.negative, x.positive) for x in r] == [("Brand#2", 835, 807)]
    assert K.developer_reviews_analysis(b.reviews, b.devs, "nobody").count() == 0
    batch = K.developer_reviews_all(b.reviews, b.devs).where(F.col("developer") == "Brand#2").first()
    assert (batch.negative, batch.positive) == (835, 807)


def test_k6_recommend_item(b):
    rows = K.recommend_item(b.reviews, b.games, C.ITEM).collect()
    assert len(rows) == 5 and all(r.similar != C.ITEM for r in rows)
    assert [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == [1, 2, 3, 4, 5]
    assert K.recommend_item(b.reviews, b.games, "no such game").count() == 0


def test_q5_ties_break_by_key(spark):
    from ludex.operators import profile
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), ("b",), ("c",), ("d",)], "p string")
    top = profile.top_values(df, "p", 2).orderBy("rank").collect()
    assert [(r.p, r.rows, r["rank"]) for r in top] == [("a", 2, 1), ("b", 2, 2)]


def test_q10_one_row_per_developer_spelling(spark):
    devs = spark.createDataFrame([(1, "Acme", "acme"), (2, "ACME", "acme")],
                                 "item_id long, developer string, developer_lc string")
    reviews = spark.createDataFrame([(1, 2), (1, 0), (2, 2)], "item_id long, sentiment int")
    rows = sorted(tuple(r) for r in K.developer_reviews_analysis(reviews, devs, "acme").collect())
    assert rows == [("ACME", 0, 1), ("Acme", 1, 1)]


def test_q12_duplicate_user_rows_take_largest_count(spark):
    items = spark.createDataFrame([(7, 1)], "user_id long, item_id long")
    prices = spark.createDataFrame([(1, 2.5)], "item_id long, price double")
    reviews = spark.createDataFrame([(7, True)], "user_id long, recommend boolean")
    counts = spark.createDataFrame([(7, 3), (7, 5)], "user_id long, items_count long")
    r = K.user_data(items, prices, reviews, counts, 7).first()
    assert (r.money_spent, r.recommend_pct, r.items_count) == (2.5, "100.0%", 5)
