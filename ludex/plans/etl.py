"""Materialise the derived tables (T1-T13) from the three raw inputs.

Each table is written once as Parquet; the questions then read narrow, clustered tables:

  games        T1   clustered by developer_lc (K1 point lookups read few row groups)
  price_report, date_report   what the cleaning rules could not read
  prices       T2
  genres       T3
  genres_x     T4   clustered by genre_lc (K3)
  devs         T5   clustered by developer_lc (K4, K5)
  library      T6   nested libraries
  user_items   T8   clustered by user_id (K2, K3)
  item_counts  T7   clustered by user_id (K2)
  reviews      T11  partitioned by review_year (K4 prunes whole folders), clustered by item_id
  user_ratings      user, item, recommend of T11, clustered by user_id (K2)
  scores       T12  long user x item table
  similar      T13  top-k others per item (zeros filled in), clustered by item (K6 lookups)
  quarantine        lines that did not parse

Writes go to ``out_dir`` (a shared filesystem / object store on a cluster). Each written
table also cuts the lineage for the jobs that read it, so an executor lost late in the
chain never recomputes the raw parse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ludex import schemas
from ludex.operators import recommend
from ludex.plans import tables as T
from ludex.sources import json_lines, literal_lines, text_lines
from ludex.sources.parquet import write_table


def materialize_all(spark: SparkSession, catalogue_path: str, libraries_path: str, reviews_path: str,
                    lexicon: DataFrame, out_dir: str, top_k: int = 5) -> dict[str, str]:
    """Run the whole ETL; returns table name -> path."""
    out = out_dir.rstrip("/")
    paths: dict[str, str] = {}

    def put(name: str, df: DataFrame, **kw) -> DataFrame:
        path = f"{out}/{name}"
        write_table(df, path, **kw)
        paths[name] = path
        return spark.read.parquet(path)

    # T1-T5 from the catalogue (strict JSON lines).
    raw = put("catalogue", json_lines.ingest_with_rest(spark, catalogue_path, schemas.CATALOGUE, schemas.OTHER))
    games = put("games", T.build_games(raw), cluster_by=["developer_lc"])
    put("price_report", T.unparsed_prices(raw))
    put("date_report", T.date_null_report(raw))
    put("prices", T.build_prices(games))
    genres = put("genres", T.build_genres(games))
    put("genres_x", T.explode_genres(genres), cluster_by=["genre_lc"])
    put("devs", T.derive_game_dev(games), cluster_by=["developer_lc"])

    # T6-T8 from the library lines (Python literals). The parse is written once; typed
    # rows and quarantined lines are both read from that table.
    lib_parsed = put("libraries_parsed", literal_lines.parse_literal_lines(
        text_lines.read_numbered_lines(spark, libraries_path, T.ORDINAL), schemas.LIBRARY, ordinal=T.ORDINAL))
    lib_rows, lib_bad = literal_lines.split_parsed(lib_parsed, schemas.LIBRARY)
    put("quarantine_libraries", lib_bad)
    nested, counts = T.split_user_items(lib_rows)
    put("item_counts", counts, cluster_by=["user_id"])
    nested = put("library", nested)
    put("user_items", T.explode_user_items(nested), cluster_by=["user_id"])

    # T9-T11 from the review lines.
    rev_parsed = put("reviews_parsed", literal_lines.parse_literal_lines(spark.read.text(reviews_path), schemas.REVIEWS))
    rev_rows, rev_bad = literal_lines.split_parsed(rev_parsed, schemas.REVIEWS)
    put("quarantine_reviews", rev_bad)
    user_reviews = put("user_reviews", T.build_user_reviews(rev_rows))
    pre = put("reviews_pre", T.explode_reviews(user_reviews))
    reviews = put("reviews", T.derive_reviews(pre, lexicon),
                  partition_by=["review_year"], cluster_by=["item_id"])

    put("user_ratings", reviews.select("user_id", "item_id", "recommend"), cluster_by=["user_id"])

    # Long scores and the top-k similar items. The stored pairs are not written.
    scores = put("scores", recommend.user_item_scores(reviews, games))
    names = recommend.item_names(games)
    keyed = scores.withColumnRenamed("item", "name").join(names, "name").select("user_id", "item", "score")
    put("similar", recommend.top_k_of_scores(keyed, names, top_k), cluster_by=["item"])
    return paths
