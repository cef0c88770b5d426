"""Training-data steps whose work grew faster than it must."""

import collections

import pytest
from pyspark.sql import functions as F

from ludex.llm import jaccard_join, line_templates, suffix_dedup
from tests.llm.test_corpus import brute_components, jaccard_rows


def test_later_whole_copies_are_not_filed(spark, monkeypatch):
    """A hot anchor's runs of copies were filed, joined and dropped again."""
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(5, words), (1, words), (9, words), (3, words + " more"), (None, "short"), (7, "short"), (9, words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    filed, plain = [], suffix_dedup.file_anchors
    monkeypatch.setattr(suffix_dedup, "file_anchors", lambda d: filed.append(d) or plain(d))
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.dedup(docs, shard_runs=2).collect()}
    n = len(words)
    assert got == {(5, n, n, 1), (1, n, 0, 0), (9, n, n, 1), (3, n + 5, n, 1), (None, 5, 0, 0), (7, 5, 0, 0)}
    assert sorted(r.id for r in filed[0].select("id").collect()) == [suffix_dedup.NO_ID, 1, 3]


def test_leaves_are_counted_without_the_lines(spark):
    """The leaves are those of the lines, found without their masks, lengths and line sets."""
    rows = [(1, "one two three four\nfew words\n a  b1 c@x http://d e \n\none two three four"), (2, "é 😀 x y z\tw\x0bv"), (None, "a b c d"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = lambda d: sorted(map(tuple, d.select("leaf", "__id").distinct().collect()))
    leaves = line_templates.leaves_of(docs)
    assert pairs(leaves) == pairs(line_templates.lines_of(docs)) and leaves.count() == 4
    plan = leaves._jdf.queryExecution().optimizedPlan().toString()
    assert "chars" not in plan and "line_no" not in plan
    assert docs.select(F.size(line_templates.masked_tokens(F.lit(" a  b1 c@x "))).alias("n")).first().n == 3


def test_hot_runs_are_marked_without_a_join(spark):
    """Hot runs were joined with the runs that stand: one row for every copy."""
    rows = [(fp, run, doc, 0, first, 7, 3) for fp in (1, 2) for run in (10, 11) for doc in range(20) for first in (run, run + 50 * fp)]
    frame = spark.createDataFrame(rows + rows[:5], "fp long, run long, id long, dup int, first long, size int, shards int")
    found = suffix_dedup.hot_runs(frame)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    got = set(map(tuple, found.select("fp", "id", "first", "size", "copy").collect()))
    stands = {(fp, 0, run, 7, False) for fp in (1, 2) for run in (10, 11)}
    assert got == stands | {(fp, doc, first, 7, True) for fp, _, doc, _, first, _, _ in rows}


def test_hot_runs_lose_the_same_bytes(spark):
    """Near copies and a common passage under hot anchors: as under usual ones."""
    passage = " ".join(f"common{i}" for i in range(40))
    rows = [(i, f"{' '.join(f'own{i}x{j}' for j in range(30))} {passage} end{i} " + (passage if i % 3 == 0 else "")) for i in range(30)]
    rows += [(100 + i, passage[i:] + f" tail{i} " + passage) for i in range(10)] + [(None, passage), (5, passage + " other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few, many = (sorted(map(str, suffix_dedup.dedup(docs, shard_runs=n).collect())) for n in (2, 10 ** 6))
    assert few == many


def written_by(monkeypatch) -> dict:
    """The tables that the Jaccard join writes, by name."""
    written, plain = {}, jaccard_join.materialize

    def keep(df, name, **options):
        written[name] = plain(df, name, **options)
        return written[name]

    monkeypatch.setattr(jaccard_join, "materialize", keep)
    return written


def test_common_passage_does_not_reach_prefixes(spark, monkeypatch):
    """Tokens that come into prefixes because others went back had no level, however many
    documents held them, and met every document with the passage."""
    written = written_by(monkeypatch)
    passage = " ".join(f"common{i}" for i in range(90))
    rows = [(i, " ".join(f"own{i}x{j}" for j in range(100)) + " " + passage) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard_join.join_components(docs).collect()} == {(i, i) for i in range(200)}
    held = collections.Counter(r.token for r in written["entries"].collect())
    assert max(held.values(), default=0) < 2 * jaccard_join.OFTEN


@pytest.mark.parametrize(("hot", "cells", "often"), [(1, 8, 2), (5, 1 << 22, 2), (14, 8, 16)])
def test_jaccard_ways_of_hot_tokens_and_copies_agree(spark, monkeypatch, hot, cells, often):
    for name, value in (("HOT_LEVEL", hot), ("CLASS_CELLS", cells), ("OFTEN", often)):
        monkeypatch.setattr(jaccard_join, name, value)
    written = written_by(monkeypatch)
    rows = [r for r in jaccard_rows() if r[0] is not None]
    got = jaccard_join.join_components(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows))
    assert ("hot-entries" in written) == (hot < 14)


def test_prefixes_of_single_sets_are_not_joined(spark, monkeypatch):
    """All prefixes were shuffled twice to find those of equal sets."""
    written = written_by(monkeypatch)
    texts = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, texts[3].upper()), (101, texts[7]), (7, texts[7]), (102, ""), (None, texts[9])]
    jaccard_join.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in written["prefixes"].where("copied").collect()} == {3, 7, 100, 101}
    assert written["prefixes"].count() == 33
