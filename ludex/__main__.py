"""Command line: build the tables, then ask the six questions against them.

    python -m ludex etl --catalogue C --libraries L --reviews R --lexicon LEX.parquet --out DIR
    python -m ludex ask developer "Some Studio" --tables DIR
    python -m ludex ask userdata some-user-id --tables DIR
    python -m ludex ask userforgenre action --tables DIR
    python -m ludex ask bestdeveloperyear 2012 --tables DIR
    python -m ludex ask developerreviews "Some Studio" --tables DIR
    python -m ludex ask recommenditem "Some Game" --tables DIR

Answers are printed as JSON lines (a handful of rows per question). On a cluster,
pass the shared output folder and submit with spark-submit; ``--master`` defaults to the
session's own.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from ludex.operators import recommend
from ludex.plans import etl
from ludex.plans import questions as K
from ludex.session import build_session


def _tables(spark: SparkSession, d: str, *names: str):
    return [spark.read.parquet(f"{d.rstrip('/')}/{n}") for n in names]


def _ask(spark: SparkSession, q: str, arg: str, d: str):
    if q == "developer":
        (games,) = _tables(spark, d, "games")
        return K.developer_free_share(games, arg).orderBy("release_year")
    if q == "userdata":
        ui, pr, rv, ic = _tables(spark, d, "user_items", "prices", "user_ratings", "item_counts")
        return K.user_data(ui, pr, rv, ic, arg)
    if q == "userforgenre":
        gx, ui = _tables(spark, d, "genres_x", "user_items")
        return K.user_for_genre(gx, ui, arg).orderBy("release_year", ascending=False)
    if q == "bestdeveloperyear":
        rv, dv = _tables(spark, d, "reviews", "devs")
        return K.best_developer_year(rv, dv, int(arg)).orderBy("rank")
    if q == "developerreviews":
        rv, dv = _tables(spark, d, "reviews", "devs")
        return K.developer_reviews_analysis(rv, dv, arg)
    if q == "recommenditem":
        (similar,) = _tables(spark, d, "similar")
        return recommend.similar_from_table(similar, arg).orderBy("rank")
    raise SystemExit(f"unknown question {q}")


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="python -m ludex")
    ap.add_argument("--master", default=None)
    sub = ap.add_subparsers(dest="cmd", required=True)
    e = sub.add_parser("etl")
    for name in ("catalogue", "libraries", "reviews", "lexicon", "out"):
        e.add_argument(f"--{name}", required=True)
    a = sub.add_parser("ask")
    a.add_argument("question")
    a.add_argument("argument")
    a.add_argument("--tables", required=True)
    args = ap.parse_args(argv)

    spark = build_session(args.master) if args.master else SparkSession.builder.getOrCreate()
    if args.cmd == "etl":
        lexicon = spark.read.parquet(args.lexicon)
        for name, path in etl.materialize_all(spark, args.catalogue, args.libraries, args.reviews,
                                              lexicon, args.out).items():
            print(json.dumps({"table": name, "path": path}))
    else:
        for row in _ask(spark, args.question, args.argument, args.tables).toLocalIterator():
            print(json.dumps(row.asDict(), default=str))


if __name__ == "__main__":
    main()
