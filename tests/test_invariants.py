"""Invariants on whole derived tables, sf0.01 bindings."""

import pytest
from pyspark.sql import functions as F

from ludex.operators import profile, recommend
from ludex.plans import catalog as C
from ludex.plans import questions as K
from ludex.plans import tables as T

SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def b(spark):
    return C.Bound(spark, SF01)


def test_similarity_range_and_no_self_pairs(b):
    pairs = recommend.item_similarity(b.reviews, b.games)
    r = pairs.agg(F.min("sim").alias("lo"), F.max("sim").alias("hi"),
                  F.count_if(F.col("item_a") >= F.col("item_b")).alias("bad_order")).first()
    assert -1.0 <= r.lo and r.hi <= 1.0 and r.bad_order == 0


def test_topk_is_consistent_with_pairs(b):
    top = K.similar_items_topk(b.reviews, b.games, 5)
    assert top.where(F.col("item") == F.col("similar")).count() == 0
    per_item = top.groupBy("item").agg(F.max("rank").alias("m"), F.count(F.lit(1)).alias("n"))
    assert per_item.where((F.col("m") != F.col("n")) | (F.col("n") > 5)).count() == 0


def test_percentages_and_counts(b):
    vp = profile.value_percentages(b.genres_x, "genre")
    r = vp.agg(F.sum("rows").alias("s"), F.min("pct").alias("lo"), F.max("pct").alias("hi")).first()
    nulls = b.genres_x.where(F.col("genre").isNull()).count()
    assert r.s + nulls == b.genres_x.count()
    assert 0.0 <= r.lo and r.hi <= 100.0
    np_ = profile.null_profile(b.games.drop("genres"))
    assert np_.where((F.col("not_null_pct") < 0) | (F.col("null_pct") > 100)).count() == 0


def test_exploded_rows_at_least_nested(b):
    assert T.explode_genres(b.genres).count() >= b.genres.count()
    assert T.unparsed_prices(b.games_raw).count() == 0


def test_free_share_labels_are_percentages(b):
    labels = [r.free_content for r in K.developer_free_share_all(b.games).collect()]
    assert all(l.endswith("%") and 0.0 <= float(l[:-1]) <= 100.0 for l in labels)
