"""Time the six questions on written tables (the production layout), not on bindings.

    python tools/bench_tables.py /root/testdata/sf0.1

Writes raw inputs derived from the test tables (catalogue JSON lines, library and review
Python-literal lines) to a scratch folder below the shared folder, runs the ETL once
(timed), then times each question (single and batch form) twice on the written tables.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from ludex import schemas  # noqa: E402
from ludex.operators import recommend  # noqa: E402
from ludex.plans import catalog as C  # noqa: E402
from ludex.plans import etl  # noqa: E402
from ludex.plans import questions as K  # noqa: E402
from ludex.session import build_session, scratch_path  # noqa: E402
from ludex.sources import bindings as B  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", 8)
    root = scratch_path(spark, "bench-tables")
    cat, lib, rev = (f"{root}/raw/{n}" for n in ("catalogue", "libraries", "reviews"))
    B.games_raw(spark, sf).withColumn("id", F.col("id").cast("string")).write.json(cat)
    B.library_literal_lines(spark, sf).write.text(lib)
    B.review_literal_lines(spark, sf).write.text(rev)
    lexicon = spark.createDataFrame(C.DEMO_LEXICON, schemas.LEXICON)

    t0 = time.perf_counter()
    paths = etl.materialize_all(spark, cat, lib, rev, lexicon, f"{root}/tables")
    etl_s = round(time.perf_counter() - t0, 3)
    t = {k: spark.read.parquet(v) for k, v in paths.items()}
    item = t["similar"].select("item").first()[0]
    user = t["user_items"].select("user_id").first()[0]
    qs = {
        "developer_free_share": lambda: K.developer_free_share(t["games"], C.DEVELOPER),
        "developer_free_share_all": lambda: K.developer_free_share_all(t["games"]),
        "user_data": lambda: K.user_data(t["user_items"], t["prices"], t["reviews"], t["item_counts"], user),
        "user_data_all": lambda: K.user_data_all(t["user_items"], t["prices"], t["reviews"], t["item_counts"]),
        "user_for_genre": lambda: K.user_for_genre(t["genres_x"], t["user_items"], C.GENRE),
        "user_for_genre_all": lambda: K.user_for_genre_all(t["genres_x"], t["user_items"]),
        "best_developer_year": lambda: K.best_developer_year(t["reviews"], t["devs"], C.YEAR),
        "best_developer_all_years": lambda: K.best_developer_all_years(t["reviews"], t["devs"]),
        "developer_reviews_analysis": lambda: K.developer_reviews_analysis(t["reviews"], t["devs"], C.DEVELOPER),
        "developer_reviews_all": lambda: K.developer_reviews_all(t["reviews"], t["devs"]),
        "recommend_item_lookup": lambda: recommend.similar_from_table(t["similar"], item),
        "recommend_item": lambda: K.recommend_item(t["reviews"], t["games"], item),
    }
    times = {}
    for name, fn in qs.items():
        for _ in range(2):
            s = time.perf_counter()
            fn().write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - s, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    print(json.dumps({"metric": "questions_on_written_tables_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "etl_seconds": etl_s, "queries": times, "sf_dir": sf}))


if __name__ == "__main__":
    main()
