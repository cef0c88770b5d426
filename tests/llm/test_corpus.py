"""Operators over the whole corpus: suffix dedup, decontamination, line dedup, Jaccard join."""

from __future__ import annotations

import collections
import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ludex.llm import components, decontamination, jaccard_join, line_templates, suffix_dedup, text

from . import fixtures as X


def duck(sql: str, **tables) -> pd.DataFrame:
    con = duckdb.connect()
    for name, (rows, cols) in tables.items():
        con.register(name, pd.DataFrame(rows, columns=cols))
    return con.sql(sql).df()


def same_rows(got: pd.DataFrame, want: pd.DataFrame) -> None:
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    def key(df):
        return sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))
    assert key(got) == key(want)


COLS = ["doc_id", "text", "lang", "source", "n_chars"]


# ------------------------------------------------------------------ suffix dedup

def brute_suffix(rows) -> dict:
    seen, out = set(), {}
    order = sorted({(r[0] if r[0] is not None else -(1 << 63), r[1] or "") for r in rows})
    for i, text in order:
        b = text.encode()
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - 99):
            s = b[p:p + 100]
            if s in seen:
                gone[p:p + 100] = True
            else:
                seen.add(s)
        spans = int(np.sum(gone & ~np.concatenate([[False], gone[:-1]]))) if len(b) else 0
        kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        out[i, text] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def suffix_rows() -> list[tuple]:
    rng = random.Random(4)
    passage, other = X.prose(rng, 60), X.prose(rng, 40)
    extra = [X.prose(rng, 20) + passage + X.prose(rng, 15), passage, passage * 3, "z" * 450, "z" * 99, "ab" * 300,
             other + "\n" + passage + other, (X.prose(rng, 20) + "é" * 70 + passage[:130]), passage[:100], passage[1:100]]
    rows = X.documents(extra=extra)
    rows += [rows[-3], (None, passage, None, None, None), (None, passage, None, None, None)]
    rows += [(1000 + i, passage[: 100 + 7 * i] + X.prose(rng, 5), "en", "s", 0) for i in range(12)]
    return rows


@pytest.mark.parametrize("options", [{}, {"shard_runs": 2}])
def test_suffix_dedup_matches_brute_force(spark, options):
    rows = suffix_rows()
    want = brute_suffix(rows)
    got = suffix_dedup.dedup(X.with_clashes(X.frame(spark, rows)), **options).collect()
    assert sorted(map(str, ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got))) == sorted(
        map(str, ((r[0], *want[r[0] if r[0] is not None else -(1 << 63), r[1] or ""]) for r in rows)))


def strings_of_one_anchor(n: int) -> list[tuple]:
    """Rows as two shards send them: every string once from each."""
    return [(i if k else 10_000 + i, 0, 7, 107, 5, k, 2, f"{i:0100d}".encode()) for i in range(n) for k in (0, 1)]


def test_shards_are_merged_by_binary_search(monkeypatch):
    """The task that merges a range's strings, shard after shard; strings lie across batches."""
    rows = sorted(strings_of_one_anchor(500), key=lambda r: (r[5], r[7]))
    rows += [(3, 0, 7, 107, 6, 0, 2, b"a" * 100), (2, 0, 7, 107, 6, 1, 2, b"a" * 100), (4, 0, 7, 107, 6, 2, 2, b"a" * 100)]
    merged, add = [], suffix_dedup.Merge.add
    monkeypatch.setattr(suffix_dedup.Merge, "add", lambda self, run: merged.append(len(run)) or add(self, run))
    found = [i for out in suffix_dedup.merge_shards(suffix_dedup._intervals(rows[k:k + 7]) for k in range(0, len(rows), 7))
             for i in out.column(0).to_pylist()]
    assert sorted(found) == sorted([10_000 + i for i in range(500)] + [3, 4])
    assert merged == [500, 500, 1, 1, 1]


def test_the_jobs_main_path_merges_shards(spark):
    """An anchor with runs in several shards: strings meet in the merge, not before."""
    rng = random.Random(9)
    passage = X.prose(rng, 40)[:140]
    rows = [(i, X.prose(rng, 12) + passage[i % 7:] + X.prose(rng, 8), "en", "s", 0) for i in range(40)]
    want = brute_suffix(rows)
    plan = suffix_dedup.dedup(X.frame(spark, rows), shard_runs=3)
    assert "merge_shards" in plan._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in plan.collect()} == {i: want[i, t] for i, t, *_ in rows}


def test_later_whole_copies_lose_everything(spark):
    rng = random.Random(10)
    long, short = X.prose(rng, 60), "too short to repeat"
    rows = [(i, long if i % 2 else short, "en", "s", 0) for i in range(30)]
    got = {r.doc_id: r for r in suffix_dedup.dedup(X.frame(spark, rows), shard_runs=4).collect()}
    assert [i for i in got if got[i].n_removed] == [i for i in got if i % 2 and i > 1]
    assert all(got[i].n_removed == got[i].n_bytes and got[i].n_spans == 1 for i in range(3, 30, 2))


def test_strings_of_one_anchor_are_dealt_to_many_tasks(spark):
    found = spark.createDataFrame(strings_of_one_anchor(400), suffix_dedup.INTERVALS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = suffix_dedup.dealt_by_string(found).select("string", F.spark_partition_id().alias("task")).distinct().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == 400 and len({r.task for r in got}) > 1


def test_suffix_dedup_empty_table(spark):
    assert suffix_dedup.dedup(X.frame(spark, [])).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=260), min_size=1, max_size=6))
def test_shard_solver_finds_all_repeats(parts):
    segments = [("ab" * 60 + p).encode() for p in parts]
    owner, inside, repeat = suffix_dedup.repeats(segments)
    seen = set()
    for o, i, r in zip(owner, inside, repeat, strict=True):
        s = segments[o][i:i + 100]
        assert len(s) == 100 and r == (s in seen)
        seen.add(s)


@settings(max_examples=30, deadline=None)
@given(st.binary(min_size=0, max_size=700))
def test_anchor_runs_split_all_strings(raw):
    data = np.frombuffer(raw, dtype=np.uint8)
    fp, place, first, last = suffix_dedup.anchor_runs(data, text.prefix_hash(data))
    starts = [p for a, b in zip(first, last, strict=True) for p in range(a, b + 1)]
    assert starts == list(range(max(0, len(raw) - 99)))
    assert all(a <= p + 0 and p >= b and p <= a + 100 - suffix_dedup.GRAM for a, b, p in zip(first, last, place, strict=True))


def test_segments_come_in_few_batches(monkeypatch):
    texts = [bytes([65 + k]) * 150 for k in range(6)]
    run = [("fp", pa.int64()), ("shard", pa.int32()), ("shards", pa.int32()), ("first", pa.int64()), ("size", pa.int32()), ("copy", pa.bool_())]
    runs = [[dict(fp=k, shard=0, shards=1, first=f, size=3, copy=f == 9) for f in (9, k)] if k % 3 else None for k in range(6)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(6), pa.int64()), pa.array([0] * 6, pa.int32()), pa.array([suffix_dedup.zstandard.compress(t) for t in texts]),
         pa.array(runs, pa.list_(pa.struct(run)))], names=["id", "dup", "text", "runs"])
    want = [(k, 0, 1, k, 0, k, texts[k][k:k + 102]) for k in range(6) if k % 3]
    for limit, n in ((1 << 20, 1), (200, 2)):
        monkeypatch.setattr(suffix_dedup, "SEGMENT_BYTES", limit)
        got = list(suffix_dedup.cut_segments(iter([batch])))
        assert len(got) == n
        assert [tuple(r.values()) for b in got for r in b.to_pylist()] == want


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 40), st.integers(1, 9)), max_size=30))
def test_spans_are_united(spans):
    row, lo, size = (np.array([s[k] for s in spans], dtype=np.int64) for k in range(3))
    covered = {(r, a + j) for r, a, n in spans for j in range(n)}
    got = list(zip(*(x.tolist() for x in suffix_dedup.united(row, lo, lo + size)), strict=True))
    assert [(r, j) for r, a, b in got for j in range(a, b)] == sorted(covered)
    assert all((r, a - 1) not in covered and (r, b) not in covered for r, a, b in got)


@given(st.lists(st.integers(0, 99), min_size=1, max_size=40), st.integers(1, 40))
def test_sliding_min_matches_plain(values, width):
    got = suffix_dedup.sliding_min(np.array(values, dtype=np.uint64), min(width, len(values)))
    assert got.tolist() == [min(values[i:i + min(width, len(values))]) for i in range(len(got))]
    assert len(got) == len(values) - min(width, len(values)) + 1


def test_long_texts_are_cut_between_starts():
    got = suffix_dedup.pieces(1000, 300)
    assert [p for lo, hi in got for p in range(lo, hi - 99)] == list(range(901))


# ------------------------------------------------------------------ decontamination

BENCHMARK = "item_id long, text string"
ITEMS = [(1, "A red train travels slowly for 120 km towards the distant town with Alice on board while another train with 120 seats waits"),
         (2, "Lorem vendi tarquo selmi norda pelvi onta."), (3, None), (4, ""), (5, "12 13 14 15 16 17 18 19 20 21"),
         (6, "short item here"), (1, "A red train travels slowly for 120 km towards the distant town with Alice on board while another train with 120 seats waits"),
         (None, "Unter drako selvi mondra tepla visko orna palu gento.")]
LEAKS = ["x. A red train travels slowly for 120 km towards the distant town with Alice on board while another train with 120 seats waits y",
         "Now a red train travels slowly for 450 km towards the distant town with Robert on board while another train with 450 seats waits",
         "Now a red train travels slowly for 450 km towards the distant town with Robert on board while another train with 75 seats waits",
         "lorem vendi tarquo SELMI norda, pelvi onta", "unter drako selvi mondra tepla visko orna palu gento",
         "A red train travels slowly", "1 2 3 4 5 6 7 8 9 10 11 12", "short item here"]


def test_decontamination_matches_sql_and_catches_changed_parameters(spark):
    rows = X.documents(extra=LEAKS)
    rows += [rows[-8], (None, LEAKS[0], None, None, None)]
    docs, items = X.with_clashes(X.frame(spark, rows)), X.frame(spark, ITEMS, BENCHMARK)
    got = decontamination.report(docs, items).toPandas()
    same_rows(got, duck(decontamination.REPORT_SQL, documents=(rows, COLS), benchmark=(ITEMS, ["item_id", "text"])))
    first = len(X.edge_texts()) + 40
    found = {(r.doc_id, r.item_id): r.verbatim for r in got.itertuples()}
    assert found[first, 1] and not found[first + 1, 1] and (first + 2, 1) not in found and found[first + 3, 2]
    kept = decontamination.decontaminate(docs, items)
    assert kept.columns == docs.columns
    bad = {i for i, _ in found if i == i}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in rows if r[0] is not None and r[0] not in bad)


MASKED = [(1, "What is 12 + 7?"), (2, "Convert 5 km to miles and 3 feet to inches"), (3, "12 13 14 15 16 17 18 19 20 21"), (None, "2 + 2 = 4"),
          (4, None), (5, ""), (6, "Yes"), (7, "12"), (8, "Who wins?"), (9, "Convert 5 km to miles and 3 feet to inches"),
          (10, "Add 4 and 4 and 9 then")]
# (text, items found in it, verbatim or not)
MASKED_TEXTS = [
    ("Q: what is 12 + 7? A: 19", {1: True}), ("Q: what is 12 + 8? A: 20", {1: False}), ("What is 12 - 7?", {}), ("They ask what is 12 + 8 now", {}),
    ("They ask what is 12 + 7 now", {1: True}), ("Convert 9 km to miles and 4 feet to inches", {2: False, 9: False}),
    ("Now convert 5 km to miles and 3 FEET to inches.", {2: True, 9: True}), ("now convert 6 km to miles and 3 feet to inches, please", {2: False, 9: False}),
    ("convert 6 km to miles and 3 inches to feet", {2: False, 9: False}), ("convert 6 km into miles and 3 feet to inches", {}),
    ("11 12 13 14 15 16 17 18 19 20 21 22", {3: True}), ("12 13 14 15 16 17 18 19 20 22 21", {}), ("1 2 3 4 5 6 7 8 9 10", {}),
    ("So 2 + 2 = 4, they say", {None: True}), ("So 2 + 3 = 5", {}), ("a line\n3 + 3 = 6\nand more", {None: False}), ("3 + 4 = 6", {}), ("yes", {}), ("12", {}),
    ("Yes. 12. Nothing more", {}), ("Right. Who wins? We do.", {8: True}), ("We know who wins? maybe", {}), ("who wins", {8: True}),
    ("add 5 and 5 and 2 then", {10: False}), ("add 5 and 6 and 2 then", {}), ("", {}), (None, {}), ("z " * 40_000 + "who wins", {})]


def test_items_without_windows_are_matched_whole(spark):
    rows = [(i, t, "en", "s", 1) for i, (t, _) in enumerate(MASKED_TEXTS)]
    docs, items = X.with_clashes(X.frame(spark, rows)), X.frame(spark, MASKED, BENCHMARK)
    got = decontamination.report(docs, items).toPandas()
    found = collections.defaultdict(dict)
    for r in got.itertuples():
        found[r.doc_id][None if r.item_id != r.item_id else int(r.item_id)] = r.verbatim
    assert {i: found.get(i, {}) for i in range(len(rows))} == {i: want for i, (_, want) in enumerate(MASKED_TEXTS)}
    kept = sorted(r.doc_id for r in decontamination.decontaminate(docs, items).collect())
    assert kept == [i for i, (_, want) in enumerate(MASKED_TEXTS) if not want]
    small = rows[:-1]
    got = decontamination.report(X.frame(spark, small), items).toPandas()
    want = duck(decontamination.REPORT_SQL, documents=(small, COLS), benchmark=(MASKED, ["item_id", "text"]))
    plain = [sorted((int(r.doc_id), -1 if r.item_id != r.item_id else int(r.item_id), int(r.n_matched), int(r.n_windows), bool(r.verbatim))
                    for r in df.itertuples()) for df in (got, want)]
    assert plain[0] == plain[1]
    assert sorted((r.item_id, r.n_words) for r in decontamination.unmatched_items(items).collect()) == [(4, 0), (5, 0), (6, 1), (7, 1)]


def test_decontamination_empty_tables(spark):
    docs = X.frame(spark, X.documents())
    none = X.frame(spark, [], BENCHMARK)
    assert decontamination.report(docs, none).count() == 0
    assert decontamination.decontaminate(docs, none).count() == docs.count()
    assert decontamination.report(X.frame(spark, []), X.frame(spark, ITEMS, BENCHMARK)).count() == 0


# ------------------------------------------------------------------ line dedup

def line_rows() -> list[tuple]:
    rng = random.Random(8)
    rows = X.documents()
    for i in range(60):
        body = X.prose(rng, 60)
        head = f"Posted on {rng.randint(1, 28)} May by user{i} in general news" if i % 2 else "All of these words are here again today"
        rows.append((2000 + i, f"{head}\n{body}\nRead more about {rng.choice(['cats', 'dogs', 'birds'])} at our site now", "en", "s", 5))
    copy = X.prose(rng, 80)
    rows += [(3000 + i, copy, "en", "s", 6) for i in range(25)] + [(None, "All of these words are here again today\nx", None, None, None)] * 2
    return rows


def test_line_dedup_matches_sql(spark):
    rows = line_rows()
    docs = X.with_clashes(X.frame(spark, rows))
    got = line_templates.dedup(docs, report=True).toPandas()
    same_rows(got, duck(line_templates.REPORT_SQL, documents=(rows, COLS)))
    by = {r.doc_id: r for r in got.itertuples()}
    assert by[2000].n_dropped == 2 and by[2001].n_dropped == 2 and by[3000].n_dropped == 0
    out = line_templates.dedup(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes and out.count() == len(rows)
    r = out.where("doc_id = 2000").first()
    assert r.n_chars == len(r.text) and r.n_words == "clash"


def test_a_leaf_holds_several_templates(spark):
    """Three templates of one leaf with a varying name each, and prose in the same leaf."""
    rng = random.Random(14)
    tails, rows = ["on our home page", "in the monthly letter", "at the local branch"], []
    for t, tail in enumerate(tails):
        for i in range(24):
            name = "Ada" if i < 5 else f"name{'abcdefghijklmnopqrstuvwxyz'[i]}"
            rows.append((100 * t + i, f"{X.prose(rng, 30)}\nRead more about {name} {tail}", "en", "s", 1))
    for i in range(400):
        words = " ".join(X.prose(rng, 5).lower().replace(".", "").split()[:5])
        rows.append((1000 + i, f"{X.prose(rng, 30)}\nRead more about {words}", "en", "s", 1))
    got = {r.doc_id: r for r in line_templates.dedup(X.frame(spark, rows), report=True).collect()}
    assert sum(got[i].n_dropped for i in got if i < 1000) == 72
    assert sum(got[i].n_dropped for i in got if i >= 1000) == 0


def test_short_documents_lose_their_recurring_lines_but_copies_stay(spark):
    rng = random.Random(15)
    notice = "This notice stands in very many documents here"
    rows = [(i, f"{X.prose(rng, 30)}\n{notice}", "en", "s", 1) for i in range(25)]
    rows += [(100, f"own words\n{notice}", "en", "s", 1), (101, f"these other four words\n{notice}", "en", "s", 1)]
    rows += [(200 + i, f"{notice}\nonly two", "en", "s", 1) for i in range(2)]
    got = {r.doc_id: r.text for r in line_templates.dedup(X.frame(spark, rows)).collect()}
    assert got[100] == rows[25][1]                       # so is this one: two words are no line
    assert got[101] == "these other four words" and notice not in got[0]
    assert got[200] == f"{notice}\nonly two"          # the same set of lines as 201: a copy


def test_very_long_line_and_text(spark):
    long = " ".join(f"w{i % 977}x" for i in range(60_000))
    rows = [(i, f"{long}\nand a short line of words", "en", "s", 1) for i in range(3)]
    assert line_templates.dedup(X.frame(spark, rows)).where(F.length("text") > 300_000).count() == 3


def test_line_dedup_empty_table(spark):
    assert line_templates.dedup(X.frame(spark, [])).count() == 0


# ------------------------------------------------------------------ Jaccard join

def shingle_set(text: str | None) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows) -> dict:
    """(n_shingles, component) by row: rows of one id are one node."""
    sets = [(r[0], shingle_set(r[1])) for r in rows]
    parent = {i: i for i, _ in sets}
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for x in range(len(sets)):
        for y in range(x):
            (i, a), (j, b) = sets[x], sets[y]
            if i is None or j is None or not a or not b:
                continue
            both = len(a & b)
            if 100 * both >= 80 * (len(a) + len(b) - both):
                ri, rj = root(i), root(j)
                parent[max(ri, rj)] = min(ri, rj)
    return [(i, len(s), None if i is None else root(i)) for i, s in sets]


def jaccard_rows() -> list[tuple]:
    rng = random.Random(6)
    base = X.prose(rng, 120).split()
    rows = X.documents()
    common = X.prose(rng, 8)
    for i in range(60):                      # near copies, many just above or below the threshold
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 99)}"
        rows.append((500 - i, " ".join(w).upper() if i % 7 == 0 else " ".join(w), "en", "s", 0))
    chain = [f"w{i}" for i in range(100)]
    rows += [(600 + i, " ".join(chain[4 * i:4 * i + 60]), "en", "s", 0) for i in range(10)]
    rows += [(700 + i, common + "\n" + X.prose(rng, 40), "en", "s", 0) for i in range(40)]
    rows += [(800, "", "en", "s", 0), (801, None, "en", "s", 0), (802, "tiny text", "en", "s", 0), (803, "TINY\ttext", "en", "s", 0)]
    return rows + [rows[-50], (None, " ".join(base), None, None, None), (802, "other words", "en", "s", 0)]


def test_jaccard_components_match_brute_force(spark):
    rows = jaccard_rows()
    docs = X.with_clashes(X.frame(spark, rows))
    got = jaccard_join.join_components(docs).collect()
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(str, brute_components(rows)))
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = collections.Counter(c for _, _, c in set((i, 0, c) for i, _, c in brute_components(rows) if i == c and i is not None))
    assert collections.Counter(r.doc_id for r in kept.collect() if r.doc_id is not None) == want


@pytest.mark.parametrize(("led", "block", "often"), [(False, 256, 16), (True, 2, 2)])
def test_jaccard_plans_agree(spark, monkeypatch, led, block, often):
    """Only the comparison in blocks, or leaders first; small blocks, few probes a task, levels
    for tokens held twice: the same components."""
    if not led:
        monkeypatch.setattr(jaccard_join, "verified", lambda pairs, docs: pairs.where("false"))
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "PROBES", 2)
    monkeypatch.setattr(jaccard_join, "OFTEN", often)
    rows = [r for r in jaccard_rows() if r[0] is not None]
    got = jaccard_join.join_components(X.frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows))


def test_jaccard_one_large_group_near_the_limit(spark):
    """Copies with edits around the limit: many pairs are just under it, none is lost."""
    rng = random.Random(12)
    base = [f"w{rng.randint(0, 10 ** 6)}" for _ in range(160)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(160), rng.choice([1, 2, 3, 4, 5, 6])):
            words[at] = f"x{rng.randint(0, 10 ** 9)}"
        rows.append((i, " ".join(words), "en", "s", 0))
    got = jaccard_join.join_components(X.frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows))


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 200), min_size=1), st.sets(st.integers(0, 200), min_size=1), st.integers(1, 8), st.integers(1, 8))
def test_similar_sets_share_the_least_number(a, b, la, lb):
    """``least_shared``, in plain numbers, against sets in token order."""
    both = len(a & b)
    if 100 * both < 80 * (len(a) + len(b) - both):
        return
    ends = []
    for s, l in ((a, la), (b, lb)):
        need = -(-80 * len(s) // 100)
        ends.append((sorted(s), min(l, need), need))
    (x, lx, nx), (y, ly, ny) = ends
    px, py = set(x[:len(x) - nx + lx]), set(y[:len(y) - ny + ly])
    overlap = -(-80 * (len(x) + len(y)) // 180)
    assert len(px & py) >= max(min(lx, ly), overlap - max(nx - lx, ny - ly))


def test_jaccard_empty_table(spark):
    assert jaccard_join.join_components(X.frame(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60), min_size=1), st.integers(0, 99))
def test_prefixes_of_similar_sets_share_enough(a, b, seed):
    a |= set(range(100, 140))
    b |= set(range(100, 140))
    both = len(a & b)
    if 100 * both < 80 * (len(a) + len(b) - both):
        return
    rng = np.random.default_rng(seed)
    weight = rng.integers(0, 50, 200).astype(float)
    x, y = (np.array(sorted(s), dtype=np.uint64) for s in (a, b))
    lx, px = jaccard_join.choose_prefix(x, weight[x.astype(int)])
    ly, py = jaccard_join.choose_prefix(y, weight[y.astype(int)])
    assert len(set(x[:px].tolist()) & set(y[:py].tolist())) >= min(lx, ly)


def test_connected_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(30)] + [(100, 200 + i) for i in range(40)] + [(7, 7), (500, 499), (499, 500)]
    links += [(rng.randint(1000, 1040), rng.randint(1000, 1040)) for _ in range(20)]
    parent = {n: n for e in links for n in e}
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: root(n) for n in linked}


def test_jaccard_any_row_of_a_document_may_link(spark):
    """Rows of one id with different needs: the smaller decides, wherever it comes."""
    rows = []
    for d in range(0, 80, 2):
        needs = [2, 9] if d % 4 else [9, 2]
        for token in (10 * d, 10 * d + 1):
            rows += [(token, d, 50, n) for n in needs] + [(token, d + 1, 40, 9)]
    frame = spark.createDataFrame(rows, "token long, doc_id long, n_shingles long, need int").coalesce(1)
    want = {(d + 1, d) for d in range(0, 80, 2)}
    alone = spark.createDataFrame([(d, d, True) for d in range(80)], "doc_id long, comp long, sure boolean")
    members, probes = jaccard_join.block_probes(frame, alone)
    block = {r.block: r.doc_id for r in members.collect()}
    assert {(max(r.doc_id, block[r.block]), min(r.doc_id, block[r.block])) for r in probes.collect()} == want
    assert {(r.a, r.b) for r in jaccard_join.leader_pairs(frame).where("shared >= enough").collect()} == want
