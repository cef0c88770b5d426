"""Steps whose work grew faster than the tables."""

import ast
import math

import pytest
from pyspark.sql import functions as F

from ludex import schemas
from ludex.functions import clean
from ludex.operators import joins, sentiment
from ludex.plans import catalog as C
from ludex.sources import bindings as B
from ludex.sources import literal_lines


def _owned_and_prices(spark, monkeypatch, n):
    items = [(1, None)] * n + [(1, 7)] * 3 + [(2, 8)]
    games = [(None, "2.5")] * n + [(7, "1.0"), (7, "4.0"), (9, "3.0"), (None, None)]
    monkeypatch.setattr(B, "user_items", lambda s, d: spark.createDataFrame(items, "user_id int, item_id int"))
    monkeypatch.setattr(B, "games_edge", lambda s, d: spark.createDataFrame(games, "id int, price string"))


def test_null_prices_meet_counted_rows(spark, monkeypatch):
    """The join's rows grow with the prices, not with prices without id times rows without item."""
    seen = []
    join = joins.left_join
    monkeypatch.setattr(C.joins, "left_join", lambda *a, **k: (seen.append((join(*a, **k), k)), seen[-1][0])[1])
    for n in (20, 40):
        _owned_and_prices(spark, monkeypatch, n)
        got = {r.item_id: (r.rows, r.price_sum) for r in C.library_prices_null_safe(spark, "").collect()}
        assert got == {None: (n * n, n * n * 2.5), 7: (6, 15.0), 8: (1, None)}
        assert seen[-1][0].count() == n + 3 and seen[-1][1]["null_safe"]


@pytest.mark.parametrize("line", [
    "{'a': u'x', 'n': None, 't': True, 'l': [1, -2, 1.5e3], \"q\": \"y\"}", "{'a': 'x' 'y'}", "{'a': 'it\\'s'}", "{'a': 07}", "{'a': NaN}", "{'a': null}",
    "{'a': '''x'''}", "{'a': (1, 2)}", "{1: 2}", "{'a': 1, 'a': 2}", "{'a': 1_0}", "{'a': 'None True'}", "{'a': \"it's\"}", "{", "", "{'a': b'x'}", "{'é': 'ü  '}"])
def test_literal_reads_as_the_literal_parser(line):
    def of(read):
        try:
            return repr(read(line))
        except Exception as e:  # noqa: BLE001
            return type(e).__name__

    assert of(literal_lines.literal) == of(ast.literal_eval)


def test_plain_lines_skip_the_literal_parser(monkeypatch):
    monkeypatch.setattr(literal_lines.ast, "literal_eval", lambda x: pytest.fail("not needed"))
    assert literal_lines.literal("{'user_id': u'8', 'items': [{'item_id': \"1\", 'n': None}], 'ok': True}") == {
        "user_id": "8", "items": [{"item_id": "1", "n": None}], "ok": True}


def test_long_texts_with_many_phrases_are_scored_without_shuffling_token_lists(spark):
    """Texts meet their phrases before they are split, and phrases are merged run by run, where
    every phrase was tested at every token before."""
    lex = spark.createDataFrame([("fine", 1.0), ("poor", -1.0)], schemas.LEXICON)
    phrases = spark.createDataFrame([("fine day", "idiom", 2.0), ("day out", "idiom", -1.0), ("out of the", "booster", 0.5)], sentiment.PHRASES)
    unit = "(Fine) day out of the, poor \"word\" ... fine "
    df = spark.createDataFrame([(1, unit * 2000), (2, unit.strip()), (3, ""), (4, None)], "i int, text string")
    scores = sentiment.compound_scores(df, "i", "text", lex, phrases=phrases)
    got = {r.i: r.compound for r in scores.collect()}
    # "fine day" 2.0, then "out of the" boosts "poor" away from zero, then "fine".
    one = 2.0 + (-1.0 - 0.5) + 1.0
    assert got[2] == pytest.approx(one / math.sqrt(one * one + 15)) and got[3] == 0 and got[4] is None
    assert got[1] > 0.99
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(_m#" not in plan
    split = next(k for k, line in enumerate(plan.splitlines()) if "split(" in line and "Project" in line)
    assert any("Join LeftOuter" in line and "_k#" in line for line in plan.splitlines()[split:])


def test_plain_dates_read_like_the_grammar(spark):
    """The store's own spellings take a short way; a blank more sends them through the grammar."""
    names = [m for m in clean.MONTHS + clean.SHORT_MONTHS]
    texts = [f"{m.capitalize()} {d}{y}" for m in names for d in ("0", "00", "1", "05", "29", "30", "31", "32", "45") for y in ("", ".", ", 2011", ", 2011.", ", 0000", ", 1600.", ", 9999")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", clean.parse_mixed_dates(F.col("t")).alias("a"), clean.parse_mixed_dates(F.concat(F.lit(" "), "t")).alias("b")).collect()
    assert all(r.a == r.b for r in got) and sum(r.a is not None for r in got) > 300
    plan = df.select(clean.parse_mixed_dates(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert clean._PLAIN_DATE in plan
