"""Source divergence and I-Match fingerprints against plain code and their SQL, with edges."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from ludex.llm import imatch, source_divergence as S
from tests.llm import fixtures as X

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def in_duckdb(sql, rows):
    con = duckdb.connect()
    types = "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT"
    con.execute(f"CREATE TABLE documents ({types})")
    for lo in range(0, len(rows), 200):
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [list(r) for r in rows[lo:lo + 200]])
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def same(df, sql, rows):
    names, want = in_duckdb(sql, rows)
    assert set(names) == set(df.columns)
    got = df.select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


# ------------------------------------------------------------------ source divergence

def corpus(n=240):
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "Delta", "épée", "zeta", "Ärger", "rho", "tau", "中文"]
    rows = []
    for i in range(n):
        lang, source = rng.choice([("en", "a"), ("en", "b"), ("en", "c"), ("de", "a"), ("de", None), (None, "x")])
        text = " ".join(rng.choice(words[: 10 if source == "a" else 6]) + rng.choice(["", ".", "-x", "1"]) for _ in range(rng.randint(0, 30)))
        rows.append((i, text, lang, source, 0))
    rows += [(9000, None, "en", "a", 0), (9001, "", "en", "empty", 0), (9002, "never kept", "xx", "one", 0), (9003, "never kept", "xx", "two", 0)]
    return rows + [rows[0], rows[0]]


def plain_audit(rows):
    """The contract, term by term."""
    docs, times = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    groups = collections.defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        times[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= 30), key=lambda t: t.encode())
        share = {}
        for source in [*sources, None]:
            count = {t: sum(times[lang, s][t] for s in (sources if source is None else [source])) for t in kept}
            total = sum(count.values())
            share[source] = {t: (count[t], 1 + 10 ** 9 * (count[t] + 5) // (total + 5 * len(kept))) for t in kept}
        for source in sources:
            pairs = [(sum(abs(share[source][t][1] - share[o][t][1]) for t in kept), o) for o in sources if o != source]
            pairs.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, "pair", o, v, i + 1) for i, (v, o) in enumerate(pairs)]
            terms = [(share[source][t][1] - share[None][t][1], t) for t in kept if share[source][t][0] and share[source][t][1] > share[None][t][1]]
            terms.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, "term", t, v, i + 1) for i, (v, t) in enumerate(terms[:50])]
    return out


@pytest.mark.parametrize("options", [{}, {"leaves": 2, "tile": 1}])
def test_audit_equals_plain_code(spark, options):
    """Small blocks and tiles: every pair of sources meets in one task a block, once."""
    rows = corpus()
    got = [tuple(r) for r in S.audit(X.with_clashes(X.frame(spark, rows)), **options).collect()]
    assert sorted(got) == sorted(plain_audit(rows))


def test_audit_equals_sql_and_empty_table(spark):
    rows = corpus(120)
    same(S.audit(X.frame(spark, rows)), S.AUDIT_SQL, rows)
    assert S.audit(X.frame(spark, [])).count() == 0


def test_equal_subtrees_are_one_node():
    rng = np.random.default_rng(1)
    leaves = rng.integers(0, 3, (6, 64))
    leaves[3] = leaves[0]
    leaves[:, 60:] = S.HOLE
    forest = S.Forest(leaves)
    assert forest.roots[0] == forest.roots[3] and len({*forest.roots}) <= 5
    assert all(len(np.unique(level, axis=0)) == len(level) for level in forest.levels)
    totals = [int(np.maximum(row, 0).sum()) for row in leaves]
    left, right = np.triu_indices(6, 1)
    want = [sum(abs(1 + 10 ** 9 * (int(a) + 5) // (totals[i] + 300) - 1 - 10 ** 9 * (int(b) + 5) // (totals[j] + 300))
                for a, b in zip(leaves[i], leaves[j], strict=True) if a != S.HOLE) for i, j in zip(left, right, strict=True)]
    assert forest.divergences(left, right, totals, 60).tolist() == want


def test_shares_of_very_large_counts():
    counts = np.array([0, 7, 10 ** 13], dtype=np.int64)
    assert S._share(counts, 10 ** 14, 10 ** 6).tolist() == [1 + 10 ** 9 * (int(c) + 5) // (10 ** 14 + 5 * 10 ** 6) for c in counts]


# ------------------------------------------------------------------ I-Match

def prints(n=150):
    rng = random.Random(5)
    rows = [(i, X.prose(rng, rng.choice([3, 20, 60, 200, 700])), "en", "s", 0) for i in range(n)]
    rows += [(1000 + i, t, None, None, None) for i, t in enumerate(X.edge_texts())]
    return rows + [(500, rows[3][1], "en", "s", 0), (None, "no id", None, None, 0), (7, "same id", None, None, 0), rows[9]]


def test_fingerprints_equal_sql(spark, monkeypatch):
    """Also in many buckets, where the next document often is in the next one."""
    rows = prints()
    same(imatch.fingerprints(X.with_clashes(X.frame(spark, rows))), imatch.FINGERPRINTS_SQL, rows)
    monkeypatch.setattr(imatch, "BUCKET_ROWS", 7)
    monkeypatch.setattr(imatch, "MAX_BROADCAST", 0)
    same(imatch.fingerprints(X.frame(spark, rows)), imatch.FINGERPRINTS_SQL, rows)


def test_neighbours_and_likeness(spark):
    rows = [r for r in prints() if r[0] is not None]
    rows = sorted({r[0]: r for r in rows}.values())
    got = {r.doc_id: r for r in imatch.fingerprints(X.frame(spark, rows)).collect()}
    texts = [r[1] or "" for r in rows]
    for (doc, *_), text, nxt in zip(rows, texts, texts[1:] + texts[:1], strict=True):
        k = len(text) // 4
        assert got[doc].n_chars == len(text)
        assert got[doc].edited_sha256 == hashlib.sha256((text[:len(text) - k] + nxt[:k]).encode()).hexdigest()
        assert 0 <= got[doc].near_next <= 1 and 0 <= got[doc].near_edited <= 1
    by_text = collections.defaultdict(set)
    for r in rows:
        by_text[r[1] or ""].add(got[r[0]].fingerprint)
    assert all(len(p) == 1 for p in by_text.values())
    long = [got[r[0]] for r in rows if len(r[1] or "") > 800]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.2


def test_one_row_very_long_text_and_empty_table(spark):
    rng = random.Random(6)
    long = " ".join(X.prose(rng, 3000).split()) * 12
    for rows in ([(1, "only one", "en", "s", 0)], [(i, long if i == 3 else f"w{chr(97 + i)} text", "en", "s", 0) for i in range(6)]):
        same(imatch.fingerprints(X.frame(spark, rows)), imatch.FINGERPRINTS_SQL, rows)
    assert imatch.fingerprints(X.frame(spark, [])).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = imatch.fingerprints(X.frame(spark, prints(20)))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("MapInArrow", "MapInPandas", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"))
