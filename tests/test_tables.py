"""Derived-table jobs: explode semantics, null handling, invariants."""

from pyspark.sql import functions as F

from ludex.plans import tables as T
from ludex.sources import bindings as B
from tests.conftest import SF


def test_explode_keeps_empty_and_null_lists(spark):
    df = spark.createDataFrame([(1, ["x", "y"], 2000), (2, [], 2001), (3, None, 2002)],
                               "item_id int, genres array<string>, release_year int")
    out = T.explode_genres(df).orderBy("item_id", "genre").collect()
    assert [(r.item_id, r.genre) for r in out] == [(1, "x"), (1, "y"), (2, None), (3, None)]


def test_explode_user_items_hours(spark):
    nested = spark.createDataFrame(
        [("u1", [("a", 120), ("b", None)]), ("u2", [])],
        "user_id string, items array<struct<item_id:string, playtime_forever:bigint>>")
    got = sorted(tuple(r) for r in T.explode_user_items(nested).collect())
    assert got == [("u1", "a", 2.0), ("u1", "b", None), ("u2", None, None)]


def test_explode_reviews_drops_textless_and_yearless(spark):
    nested = spark.createDataFrame(
        [("u", "url", [("great", True, "i1", "Posted November 5, 2011."),
                       (None, False, "i2", "Posted May 1, 2012."),
                       ("meh", None, "i3", "Posted September 3.")])],
        "user_id string, user_url string, reviews array<struct<review:string, recommend:boolean, item_id:string, posted:string>>")
    out = T.explode_reviews(nested).orderBy("item_id").collect()
    assert [r.item_id for r in out] == ["i1", "i3"]
    assert out[0].review_year == 2011 and out[1].review_year is None and out[1].review_date is None


def test_games_invariants(spark):
    raw = B.games_raw(spark, SF)
    games = T.build_games(raw)
    assert T.unparsed_prices(raw).count() == 0
    genres = T.build_genres(games)
    assert T.explode_genres(genres).count() >= genres.count()
    assert games.where(F.col("release_year").isNull()).count() == 0


def test_build_user_reviews_drops_all_null(spark):
    lines = spark.createDataFrame([("u", "x", None), (None, None, None)],
                                  "user_id string, user_url string, reviews array<string>")
    assert T.build_user_reviews(lines).count() == 1


def test_clustered_write_splits_a_hot_key(spark):
    import tempfile

    from ludex.sources.parquet import write_table
    rows = [("hot", i) for i in range(9000)] + [(f"k{i % 50}", i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, v int")
    path = tempfile.mkdtemp(prefix="ludex-write-") + "/t"
    # Tiny data would be coalesced into one partition by AQE; at scale it is not.
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        write_table(df, path, cluster_by=["k"])
    finally:
        spark.conf.set(key, old)
    back = spark.read.parquet(path)
    assert back.count() == 10000
    files_with_hot = back.where(F.col("k") == "hot").select("_metadata.file_path").distinct().count()
    assert files_with_hot >= 2
