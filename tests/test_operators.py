"""Profiling, recommender, sentiment and ingest operators on inline rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ludex import schemas
from ludex.operators import profile, recommend, sentiment
from ludex.sources import json_lines, literal_lines


def test_describe_matches_interpolated_quartiles(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (10,)], "x int")
    r = profile.describe(df, "x").first()
    assert (r["q25"], r["q50"], r["q75"]) == (1.75, 2.5, 4.75)
    assert r["std"] == round(4.08248290463863, 6) and r["count"] == 4


def test_all_null_group_sums_to_zero(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0)], "k string, v double")
    got = dict((r.k, r.v) for r in profile.sum_per_group(df, "k", "v").collect())
    assert got == {"a": 0.0, "b": 1.0}


def test_value_percentages_count_nulls_in_denominator(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "c string")
    got = {r.c: (r.rows, r.pct) for r in profile.value_percentages(df, "c").collect()}
    assert got == {"x": (2, 50.0), "y": (1, 25.0)}
    assert sum(v[0] for v in got.values()) + 1 == df.count()


def test_null_profile_and_distinct_with_null(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (None, "a")], "a int, b string")
    prof = {r.name: (r.data_type, r.not_null_pct, r.null_pct, r.null_count) for r in profile.null_profile(df).collect()}
    assert prof == {"a": ("int", 66.67, 33.33, 1), "b": ("string", 66.67, 33.33, 1)}
    assert profile.distinct_count_with_null(df, "b").first()[0] == 2


def test_sorted_positions_nulls_last(spark):
    df = spark.createDataFrame([(2001,), (None,), (1999,), (2001,)], "y int")
    got = [(r.pos, r.y) for r in profile.sorted_positions(df, "y").orderBy("pos").collect()]
    assert got == [(1, 1999), (2, 2001), (3, None)]


def test_recommend_score(spark):
    rows = [(False, 2), (None, 2), (True, 0), (True, 1), (True, 2)]
    df = spark.createDataFrame(rows, "r boolean, s int")
    got = [x[0] for x in df.select(recommend.recommend_score(F.col("r"), F.col("s"))).collect()]
    assert got == [0, 0, 1, 2, 3]


def test_normalize_drops_constant_and_single_users(spark):
    scores = spark.createDataFrame(
        [("u1", "a", 3.0), ("u1", "b", 0.0), ("u2", "a", 3.0), ("u2", "b", 3.0), ("u2", "c", 3.0), ("u3", "a", 2.0)],
        "user_id string, item string, score double")
    got = sorted((r.user_id, r.item, r.v) for r in recommend.normalize_scores(scores).collect())
    assert got == [("u1", "a", 0.5), ("u1", "b", -0.5)]


def _pairs(spark, rows, hot_degree):
    scores = spark.createDataFrame(rows, "user_id string, item string, score double")
    w = recommend.unit_weights(recommend.normalize_scores(scores, hot_degree))
    return {(r.item_a, r.item_b): round(r.sim, 9) for r in recommend.item_pairs(w).collect()}


def test_similarity_alike_items_and_symmetry(spark):
    rows = [("u1", "a", 3.0), ("u1", "b", 3.0), ("u1", "c", 1.0),
            ("u2", "a", 1.0), ("u2", "b", 1.0), ("u2", "c", 3.0)]
    sims = _pairs(spark, rows, 2048)
    assert sims[("a", "b")] == 1.0
    assert all(-1.0 - 1e-9 <= v <= 1.0 + 1e-9 for v in sims.values())
    top = recommend.top_k_similar(spark.createDataFrame(
        [(a, b, s) for (a, b), s in sims.items()], "item_a string, item_b string, sim double"),
        spark.createDataFrame([(i,) for i in "abc"], "item string"), 5)
    assert top.where(F.col("item") == F.col("similar")).count() == 0


def test_hot_user_salting_is_exact(spark):
    # One user rates 40 items (split over 10 buckets with hot_degree=4); results must not change.
    rows = [("hot", f"i{j:02d}", float(1 + (j * 7) % 3)) for j in range(40)]
    rows += [(f"u{k}", f"i{j:02d}", float(1 + (j + k) % 3)) for k in range(6) for j in range(k, 40, 3)]
    assert _pairs(spark, rows, 4) == _pairs(spark, rows, 10_000)


def test_cosine_matches_dense_embeddings(spark):
    # Independent check of the pair arithmetic: a few dense test vectors as (user=dim, item=vec).
    from tests.conftest import SF
    emb = spark.read.parquet(f"{SF}/embeddings.parquet").where(F.col("vec_id") < 6)
    vecs = {r.vec_id: list(r.embedding) for r in emb.collect()}
    long = emb.select(F.col("vec_id").cast("string").alias("item"),
                      F.posexplode("embedding").alias("d", "v")) \
              .select(F.col("d").cast("string").alias("user_id"), "item", F.col("v").cast("double").alias("v"),
                      F.lit(1).alias("buckets"))
    sims = {(r.item_a, r.item_b): r.sim for r in recommend.item_pairs(recommend.unit_weights(long)).collect()}
    a, b = vecs[0], vecs[1]
    want = sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    assert sims[("0", "1")] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("exact_rows", [200_000, 40])
def test_values_at_equal_the_sorted_list(spark, monkeypatch, exact_rows):
    """With few rows read value by value, the cells are split again and again."""
    monkeypatch.setattr(profile, "EXACT_ROWS", exact_rows)
    monkeypatch.setattr(profile, "SPLITS", 8 if exact_rows < 100 else 4096)
    rng = random.Random(4)
    sets = {"spread": [rng.uniform(-1e6, 1e6) for _ in range(3000)], "outliers": [rng.gauss(5, 1) for _ in range(2000)] + [1e300, -1e300, 1e-300],
            "ties": [rng.choice([1.5, 2.5, 2.5, 9.0]) for _ in range(999)], "close": [1.0 + i * 2.0 ** -50 for i in range(700)], "one": [7.0],
            "special": [float("inf"), float("-inf"), 0.0, -0.0, 5.0]}
    shares = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    for values in sets.values():
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(5)
        ordered, want = sorted(values), []
        for s in shares:
            at = s * (len(values) - 1)
            lo, hi = ordered[math.floor(at)], ordered[math.ceil(at)]
            want.append(lo + (hi - lo) * (at - math.floor(at)))
        assert all(a == b or (a != a and b != b) for a, b in zip(profile.values_at(df, shares), want, strict=True))
    assert profile.values_at(df.where("false"), [0.5]) == [None]
    assert math.isnan(profile.values_at(spark.createDataFrame([(1.0,), (float("nan"),)], "v double"), [1.0])[0])


def compounds(spark, texts, lexrows):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    lex = spark.createDataFrame(lexrows, schemas.LEXICON)
    out = sentiment.compound_scores(df, "i", "text", lex).orderBy("i")
    return [r.compound for r in out.collect()]


def test_sentiment_rules(spark):
    L = [("good", 1.9), ("bad", -2.5)]
    base, neg, boost, but, bang, none, null = compounds(
        spark, ["good", "not good", "very good", "good but bad", "good!!", "nothing here", None], L)
    assert base == pytest.approx(1.9 / math.sqrt(1.9 ** 2 + 15))
    assert neg == pytest.approx(-0.74 * 1.9 / math.sqrt((0.74 * 1.9) ** 2 + 15))
    s = 1.9 + 0.293
    assert boost == pytest.approx(s / math.sqrt(s * s + 15))
    s = 0.5 * 1.9 + 1.5 * -2.5
    assert but == pytest.approx(s / math.sqrt(s * s + 15))
    s = 1.9 + 2 * 0.292
    assert bang == pytest.approx(s / math.sqrt(s * s + 15))
    assert none == 0.0 and null is None


def test_sentiment_caps_emphasis(spark):
    L = [("good", 1.9)]
    mixed, allcaps, lower = compounds(spark, ["a GOOD game", "GOOD GAME", "a good game"], L)
    s = 1.9 + 0.733
    assert mixed == pytest.approx(s / math.sqrt(s * s + 15))
    assert allcaps == lower == pytest.approx(1.9 / math.sqrt(1.9 ** 2 + 15))


def test_sentiment_class_thresholds(spark):
    df = spark.createDataFrame([(0.05,), (0.049,), (-0.05,), (None,)], "c double")
    got = [r[0] for r in df.select(sentiment.sentiment_class(F.col("c"))).collect()]
    assert got == [2, 1, 0, 1]


def test_sentiment_contractions_emoticons_and_scripts(spark):
    L = [("good", 1.9), ("like", 1.5), (":)", 2.0), ("très", 0.7), ("bad", -2.5)]
    got = compounds(spark, ["isn't good", "don't like it", ":)", "très", "not very good", "not bad", "good, really!", "so good",
                            "never so good", "the least good", "at least good", "fucking good", "Good?"], L)
    assert got[0] < 0 and got[1] < 0 and got[2] > 0 and got[3] > 0 and got[4] < 0 and got[5] > 0 and got[6] > 0
    plain = 1.9 / math.sqrt(1.9 ** 2 + 15)
    assert got[7] > plain and got[8] > got[7] and got[9] < 0 and got[10] == pytest.approx(plain)
    assert got[11] == pytest.approx(got[7]) and got[12] == pytest.approx(plain)


def test_sentiment_modifiers_are_an_input_table(spark):
    df = spark.createDataFrame([(1, "hardly good"), (2, "mega good")], "i int, text string")
    lex = spark.createDataFrame([("good", 1.9)], schemas.LEXICON)
    mods = spark.createDataFrame([("hardly", "negation", None), ("mega", "booster", 1.0)], sentiment.MODIFIERS)
    got = {r.i: r.compound for r in sentiment.compound_scores(df, "i", "text", lex, mods).collect()}
    assert got[1] < 0 and got[2] == pytest.approx(2.9 / math.sqrt(2.9 ** 2 + 15))


def unit(s):
    return pytest.approx(s / math.sqrt(s * s + 15))


def test_sentiment_phrases_and_no(spark):
    L = [("good", 1.9), ("great", 3.1), ("fun", 2.3), ("no", -1.2), ("kiss", 1.8), ("death", -2.9), ("enough", 0.5)]
    texts = ["kind of good", "SORT OF good", "no fun", "no great fun", "without doubt great", "without a doubt great", "without great",
             "kiss of death", "a kiss of life", "no", "no or nor great", "good kind of fun", "just enough fun", "Yeah right!", "kind of", "of good"]
    got = dict(zip(texts, compounds(spark, texts, L), strict=True))
    assert got["kind of good"] == unit(1.9 - 0.293) and 0 < got["kind of good"] < got["of good"]
    assert got["SORT OF good"] == unit(1.9 - 0.293 + 0.733)            # the phrase in capitals, the text mixed
    assert got["no fun"] == unit(-0.74 * 2.3) and got["no great fun"] == unit(-0.74 * (3.1 + 2.3))
    assert got["without doubt great"] == got["without a doubt great"] == unit(3.1) and got["without great"] < 0
    assert got["kiss of death"] == unit(-1.5) and got["a kiss of life"] == unit(1.8)
    assert got["no"] == unit(-1.2) and got["no or nor great"] == unit(-1.2 - 0.74 * -0.74 * 3.1)
    assert got["good kind of fun"] == unit(1.9 + 2.3 - 0.293) and got["just enough fun"] == unit(2.3 - 0.293)
    assert got["Yeah right!"] == unit(-2.0 - 0.292) and got["kind of"] == 0.0


def test_phrases_longest_first_without_overlap(spark):
    phrases = spark.createDataFrame([("a b", "idiom", 1.0), ("a b c", "idiom", 2.0), ("b c", "idiom", 4.0), ("c d", "idiom", 8.0), ("c d e f", "idiom", 16.0)],
                                    sentiment.PHRASES)
    texts = ["a b c d", "a b x", "b c d", "c d e", "x c d e f", "a a b", "A B c", "", None, "a", "a b c a b b c"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    lex = spark.createDataFrame([("zz", 1.0)], schemas.LEXICON)
    got = [r.compound for r in sentiment.compound_scores(df, "i", "text", lex, phrases=phrases).orderBy("i").collect()]
    sums = [2.0, 1.0, 4.0, 8.0, 16.0, 1.0, 2.0, 0.0, None, 0.0, 2.0 + 1.0 + 4.0]
    for g, want in zip(got, sums, strict=True):
        assert g is None if want is None else g == pytest.approx(want / math.sqrt(want * want + 15))


def test_bloom_filter_lets_every_key_pass(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    passes = sentiment.BloomFilter(keys, "h")
    assert keys.where(passes.test(F.col("h"))).count() == 3000
    others = spark.range(10_000, 30_000).select(F.xxhash64("id").alias("h"))
    assert others.where(passes.test(F.col("h"))).count() < 800


def test_only_possible_hits_leave_the_text(spark):
    """The filter stands in the projection that explodes the tokens."""
    df = spark.createDataFrame([(1, "a good game")], "i int, text string")
    plan = sentiment.compound_scores(df, "i", "text", spark.createDataFrame([("good", 1.9)], schemas.LEXICON))._jdf.queryExecution().optimizedPlan().toString()
    explode = next(line for line in plan.splitlines() if "Generate explode" in line and "_next" in line)
    assert "filter(" in explode and "shiftright" in explode


def test_classify_rows_scores_each_text_once(spark):
    rows = [("u1", "good"), ("u2", "good"), ("u3", "bad"), ("u4", None)]
    df = spark.createDataFrame(rows, "user_id string, review string")
    lex = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], schemas.LEXICON)
    got = dict((r.user_id, r.sentiment) for r in sentiment.classify_rows(df, "review", lex).collect())
    assert got == {"u1": 2, "u2": 2, "u3": 0, "u4": 1}
    assert "review" not in sentiment.classify_rows(df, "review", lex).columns


def test_literal_lines_quarantine(spark):
    lines = spark.createDataFrame(
        [("{'user_id': u'a', 'ok': True, 'n': None, 't': \"it's\"}",), ("{bad",), ('{"a": foo}',)], "value string")
    schema = "user_id string, ok boolean, n bigint, t string"
    from pyspark.sql.types import _parse_datatype_string
    rows, bad = literal_lines.ingest_literal_lines(lines, _parse_datatype_string(schema))
    assert [tuple(r) for r in rows.collect()] == [("a", True, None, "it's")]
    assert bad.count() == 2


def test_literal_lines_convert_or_quarantine(spark):
    lines = ["{'user_id': 7, 'items_count': '5', 'items': [{'item_id': 1, 'playtime_forever': '30'}]}",
             "{'user_id': 'a', 'items_count': 2, 'items': [{'item_id': '1', 'playtime_forever': 90.5}]}",
             "{'user_id': 'b', 'items': 'oops'}", "{'user_id': 'c', 'items_count': 3.0, 'items': None}", None]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    rows, bad = literal_lines.ingest_literal_lines(df, schemas.LIBRARY)
    got = {r.user_id: r for r in rows.collect()}
    assert got["7"].items_count == 5 and got["7"]["items"][0].playtime_forever == 30 and got["c"].items_count == 3
    assert sorted((r.field or "", r.line or "") for r in bad.collect()) == sorted(
        [("items.playtime_forever", lines[1]), ("items", lines[2]), ("", "")])


def test_catalogue_keeps_undeclared_columns(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"id": "1", "price": 4.5, "tags": ["a"], "early": true}\n{"id": "2"}\n')
    rows = {r.id: r for r in json_lines.ingest_with_rest(spark, str(tmp_path / "c.json"), schemas.CATALOGUE, schemas.OTHER).collect()}
    assert rows["1"].other_columns == {"tags": '["a"]', "early": "true"} and rows["1"].price == "4.5"
    assert rows["2"].other_columns is None


def test_quartiles_and_positions_over_ranges(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 10]] + [(None,)], "x double")
    r = profile.describe(df, "x").first()
    assert (r["count"], r.q25, r.q50, r.q75) == (4, 1.75, 2.5, 4.75)
    assert tuple(profile.describe(df.where("x > 99"), "x").first())[1:] == (None,) * 7
    many = spark.createDataFrame([(i % 500 if i % 7 else None,) for i in range(3000)], "k int")
    got = [(x.k, x.pos) for x in profile.sorted_positions(many, "k").orderBy("pos").collect()]
    assert got == [(k, k + 1) for k in range(500)] + [(None, 501)]


def test_json_strict_and_flatten(spark):
    df = spark.createDataFrame([('{"k": 1, "s": {"x": "a"}}',)], "value string")
    from pyspark.sql.types import _parse_datatype_string
    schema = _parse_datatype_string("k bigint, s struct<x:string>")
    flat = json_lines.flatten(json_lines.parse_json_lines(df, schema))
    assert flat.columns == ["k", "s.x"] and tuple(flat.first()) == (1, "a")
    bad = spark.createDataFrame([("{not json",)], "value string")
    with pytest.raises(Exception):
        json_lines.parse_json_lines(bad, schema).collect()


def test_null_keys_are_dealt_to_many_tasks(spark):
    """A third of the rows without a key: no task of the join gets them all."""
    from ludex.operators import joins
    items = spark.range(9000).select("id", F.when(F.col("id") % 3 != 0, F.col("id") % 100).alias("item_id")).repartition(6)
    prices = spark.createDataFrame([(i, float(i)) for i in range(100)] + [(None, 0.5), (None, 0.25)], "item_id long, price double")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        out = joins.left_join(items, prices, "item_id", null_safe=True)
        rows = out.select("id", "item_id", "price", F.spark_partition_id().alias("task")).collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "SortMergeJoin" in plan and "NestedLoop" not in plan
    nulls = [r for r in rows if r.item_id is None]
    assert len(rows) == 12_000 and sorted(r.price for r in nulls) == [0.25] * 3000 + [0.5] * 3000
    share = [sum(r.task == t for r in nulls) for t in range(8)]
    assert max(share) < len(nulls) / 2 and sum(n > 0 for n in share) > 4


def test_null_safe_left_join(spark):
    from ludex.operators import joins
    items = spark.createDataFrame([("u1", 1), ("u2", None)], "user_id string, item_id int")
    prices = spark.createDataFrame([(1, 5.0), (None, 9.0)], "item_id int, price double")
    plain = {r.user_id: r.price for r in joins.left_join(items, prices, "item_id").collect()}
    safe = {r.user_id: r.price for r in joins.left_join(items, prices, "item_id", null_safe=True).collect()}
    assert plain == {"u1": 5.0, "u2": None}
    assert safe == {"u1": 5.0, "u2": 9.0}
