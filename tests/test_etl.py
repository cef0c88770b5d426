"""End to end: raw files (JSON lines + Python-literal lines) -> every derived table."""

import os
import tempfile

from pyspark.sql import functions as F

from ludex import schemas
from ludex.plans import catalog as C
from ludex.plans import etl, questions, tables
from ludex.plans import questions as K
from ludex.sources import bindings as B
from ludex.sources import literal_lines, text_lines
from tests.conftest import SF


def test_materialize_all(spark, capsys):
    root = tempfile.mkdtemp(prefix="ludex-etl-")
    cat, lib, rev = (os.path.join(root, n) for n in ("catalogue", "libraries", "reviews"))
    B.games_raw(spark, SF).withColumn("id", F.col("id").cast("string")).write.json(cat)
    B.library_literal_lines(spark, SF).write.text(lib)
    lines = B.review_literal_lines(spark, SF)
    lines.unionByName(spark.createDataFrame([("{broken",)], "value string")).write.text(rev)
    lexicon = spark.createDataFrame(C.DEMO_LEXICON, schemas.LEXICON)

    paths = etl.materialize_all(spark, cat, lib, rev, lexicon, os.path.join(root, "out"))
    read = {k: spark.read.parquet(v) for k, v in paths.items()}

    assert read["games"].count() == B.games_raw(spark, SF).count()
    assert read["price_report"].count() == 0
    assert read["date_report"].first().null_dates > 0
    assert read["library"].count() == B.library_lines(spark, SF).count()
    assert read["quarantine_libraries"].count() == 0
    assert read["quarantine_reviews"].count() == 1
    assert read["user_items"].count() == B.user_items(spark, SF).count()
    assert read["reviews"].count() == B.reviews(spark, SF).count()
    # reviews are partitioned by year: a year filter reads one folder
    assert os.path.isdir(os.path.join(paths["reviews"], "review_year=1998"))
    assert read["similar"].where(F.col("item") == F.col("similar")).count() == 0
    # on the written tables the lower-cased key is a stored column: the lookup reaches the scan
    plan = read["devs"].where(F.col("developer_lc") == "brand#2")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(developer_lc,brand#2)" in plan
    # the questions run on the written tables
    top = K.best_developer_year(read["reviews"], read["devs"], 1998).collect()
    assert len(top) == 3

    # the command line answers the six questions from the written tables
    from ludex.__main__ import main
    out = os.path.join(root, "out")
    capsys.readouterr()
    for q, arg in [("developer", "brand#2"), ("userdata", "10"), ("userforgenre", "RING"),
                   ("bestdeveloperyear", "1998"), ("developerreviews", "Brand#2"),
                   ("recommenditem", read["similar"].select("item").first()[0])]:
        main(["ask", q, arg, "--tables", out])
        lines = [l for l in capsys.readouterr().out.splitlines() if l.startswith("{")]
        assert lines, q


def test_lines_are_numbered_as_they_stand_in_the_files(spark, tmp_path):
    """Several files, some of several splits: dense numbers, in path and line order."""
    lines = [f"line {i} " + "x" * (i % 50) for i in range(3000)]
    cuts = [0, 10, 10, 1700, 3000]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        (tmp_path / f"part-{k}.txt").write_text("".join(x + "\n" for x in lines[a:b]))
    small = {"spark.sql.files.maxPartitionBytes": "9000", "spark.sql.files.openCostInBytes": "100"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        df = text_lines.read_numbered_lines(spark, str(tmp_path))
        got = sorted((r.line_no, r.value) for r in df.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == list(enumerate(lines))


def test_first_line_of_a_user_decides_the_count(spark, tmp_path):
    rows = ["{'user_id': 'a', 'items_count': 2, 'items': []}", "{'user_id': 'b', 'items_count': 9}", "broken",
            "{'user_id': 'a', 'items_count': 7, 'items': []}", "{'user_id': 'b', 'items_count': 1}", "{'user_id': 'c', 'items': []}"]
    (tmp_path / "lines.txt").write_text("\n".join(rows) + "\n")
    good, bad = literal_lines.read_literal_lines(spark, str(tmp_path), schemas.LIBRARY)
    counts = tables.split_user_items(good)[1]
    assert {r.user_id: r.items_count for r in tables.first_item_count(counts).collect()} == {"a": 2, "b": 9, "c": None}
    assert [(r.line, r.line_no) for r in bad.collect()] == [("broken", 2)]
    owned = spark.createDataFrame([("a", 1)], "user_id string, item_id long")
    prices = spark.createDataFrame([(1, 2.5)], "item_id long, price double")
    reviews = spark.createDataFrame([("a", True)], "user_id string, recommend boolean")
    assert questions.user_data(owned, prices, reviews, counts, "a").first().items_count == 2
