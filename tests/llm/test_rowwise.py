"""Operators that judge each document alone: quality rules, token counts, classifier, personal data."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from ludex.llm import bpe_count, fm_quality, pii, quality_rules

from . import fixtures as X

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------ quality rules

def brute_base(text: str | None) -> tuple:
    text = text or ""
    words = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    windows: dict = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i:i + 3]), []).append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), failed)


def rule_texts() -> list[str]:
    rng = random.Random(5)
    good = X.prose(rng, 300)
    return [good + "\nReleased under the MIT License.", " ".join(w + "!!" for w in good.upper().split()),
            " | ".join(good.split()), " ".join(w + "***" for w in good.split()), "word " * 300,
            good + "\n" + good, " ".join(["la la"] * 40) + "\n" + good]


def test_quality_rules_match_brute_force_and_sql(spark):
    rows = X.documents(extra=rule_texts())
    got = quality_rules.verdicts(X.with_clashes(X.frame(spark, rows))).toPandas().sort_values("doc_id").reset_index(drop=True)
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for r in rows:
        assert tuple(got.loc[got.doc_id == r[0], cols].iloc[0]) == brute_base(r[1]), r[0]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    want = con.sql(quality_rules.VERDICTS_SQL).df().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want[got.columns.tolist()], check_dtype=False)
    verdict = dict(zip(got.doc_id, got.kept, strict=True))
    first = len(rows) - len(rule_texts())
    assert [bool(verdict[first + i]) for i in range(6)] == [True, False, False, False, False, False]


def test_quality_rules_remove_failing_lines_only(spark):
    good = X.prose(random.Random(5), 120)
    rows = [(1, "Home | About | News | Contact\n" + good + "\nAll rights reserved.", "en", "s", 0)]
    assert quality_rules.quality(X.frame(spark, rows)).first()["cleaned"] == good


def test_quality_rules_null_id_and_empty_table(spark):
    rows = [(None, "a b", None, None, None), (None, "a b", None, None, None)]
    assert quality_rules.verdicts(X.frame(spark, rows)).count() == 2
    assert quality_rules.verdicts(X.frame(spark, [])).count() == 0


# ------------------------------------------------------------------ token counts

def test_token_counts_match_the_library(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = X.documents(extra=["don't  stop\n\n  it's <|endoftext|>x <|endoftext|><|endo", "word " * 3000, "１２3 ½ ٣ 　z"])
    got = {r.doc_id: r for r in bpe_count.count_tokens(X.with_clashes(X.frame(spark, rows))).collect()}
    for i, text, *_ in rows:
        n = len(tok.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 1024), i
    assert bpe_count.count_tokens(X.frame(spark, [])).count() == 0


def test_token_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe_count, "CACHE_ENTRIES", 50)
    c = bpe_count.BpeCounter(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    whole = bpe_count.bpe_counter(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(50):
        text = X.prose(rng, 40)
        assert c.count(text) == whole.count(text)
        assert len(c.cache.young) + len(c.cache.old) <= 2 * (50 + 60)


# ------------------------------------------------------------------ classifier

def labelled(n: int = 400):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        text = X.prose(rng, rng.choice([40, 150, 400]))
        if not good:
            text = " ".join(w + rng.choice(["***", "&&&", "!!"]) for w in text.upper().split())
        rows.append((i, text, "en", "s", 0))
        labels.append((i, int(good), 0))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_classifier_separates_held_out_documents(spark):
    rows, labels = labelled()
    got = fm_quality.score_documents(X.with_clashes(X.frame(spark, rows)), X.frame(spark, labels, LABELS)).collect()
    quality = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in quality if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == quality[r.doc_id] for r in held]) > 0.95


def test_classifier_ignores_held_out_labels_and_other_columns(spark):
    rows, labels = labelled(150)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    other = [(i, t, "xx", "zz", 7) for i, t, *_ in rows]
    a = fm_quality.score_documents(X.frame(spark, rows), X.frame(spark, labels, LABELS))
    b = fm_quality.score_documents(X.frame(spark, other), X.frame(spark, flipped, LABELS))
    assert sorted((r.doc_id, r.score) for r in a.collect()) == sorted((r.doc_id, r.score) for r in b.collect())


def test_classifier_edges(spark):
    rows = X.documents() + [(None, "x y z", None, None, None)] * 2
    got = fm_quality.score_documents(X.frame(spark, rows), X.frame(spark, [], LABELS)).collect()
    assert len(got) == len(rows) and all(r.score == 1.0 for r in got)
    labels = [(i, None if i == 3 else i % 2, 0) for i in range(12)] * 2
    got = fm_quality.score_documents(X.frame(spark, rows), X.frame(spark, labels, LABELS)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert fm_quality.score_documents(X.frame(spark, []), X.frame(spark, labels, LABELS)).count() == 0


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    fm = fm_quality.FactorisationMachine()
    fm.w = rng.normal(size=fm.w.shape)
    fm.v = rng.normal(size=fm.v.shape)
    f = rng.choice(fm_quality.N_FEATURES, 9, replace=False)
    x = rng.normal(size=9)
    pairs = sum(fm.v[f[i]] @ fm.v[f[j]] * x[i] * x[j] for i in range(9) for j in range(i))
    got = fm.raw(np.array([0, 9]), f, x)[0][0]
    assert got == pytest.approx(fm.w[f] @ x + pairs)


# ------------------------------------------------------------------ personal data

def brute_pii(text: str | None) -> dict:
    text = text or ""
    def digits(s): return re.sub(r"[^0-9]", "", s)
    email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
          if all(int(p) <= 255 for p in m[0].split("."))]
    card = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
            if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return {"email": email, "ip": ip, "card": card, "phone": phone}


PII_TEXTS = ["mail a.b+c@x-y.example.com, or @x.com a@b a@@b.c.d x@y.z@q.r.s", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4",
             "4111 1111 1111 1111 4111-1111-1111-1112 5500005555555559 12345678901234567890",
             "+1 (386) 555-8773 and +123 +44 20 7946 0958, +1++1 202 555 0100-", "a@b.c.@d.e"]


def test_pii_base_matches_plain_patterns(spark):
    rng = random.Random(2)
    noise = ["".join(rng.choices("a1.@+ -()4", k=60)) for _ in range(400)]
    rows = X.documents(extra=PII_TEXTS + noise)
    got = {r.doc_id: r for r in pii.scan(X.with_clashes(X.frame(spark, rows))).collect()}
    for i, text, *_ in rows:
        want = brute_pii(text)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [len(want[k]) for k in pii.KINDS], text
        line = pii.render(want)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(got[i].spans.split(",")), text
    assert pii.scan(X.frame(spark, [])).count() == 0


@pytest.mark.parametrize(("kind", "hidden", "inside"), [
    ("email", "jane [at] example [dot] com", True), ("email", "jane.doe(at)mail(dot)example(dot)org", True),
    ("email", "jane at example dot com", True), ("email", "jane＠example．com", True), ("email", "jаne@example.com", True),
    ("phone", "+1 five five five 867 five three zero nine", True), ("phone", "+１ (386) 555-8773", True),
    ("phone", "plus one five five five eight six seven five three zero nine", True),
    ("ip", "26 dot 198 dot 133 dot 150", True), ("ip", "１0.0.0.1", True),
    ("card", "4111 1111 1111 one one one one", True), ("card", "four one one one 1111 1111 1111", True),
])
def test_pii_disguises_map_back_to_source(kind, hidden, inside):
    text = f"Écrire à {hidden} ou non."
    found = pii.find_disguised(text, pii.find_base(text))[kind]
    a = text.index(hidden)
    assert (a, a + len(hidden)) in found, (found, pii.deobfuscate(text).text)


@pytest.mark.parametrize("text", ["We met at noon and dot the i.", "one two buckle my shoe", "look at example.com now",
                                  "section [at] the end", "Прости меня", "five six, pick up sticks"])
def test_pii_leaves_prose_alone(text):
    assert not any(pii.find_disguised(text, pii.find_base(text)).values())


@pytest.mark.parametrize("around", ["Write to {} or not.", "Écrire à {} ou non.", "Polka dot. See {} there", "one @ two: {}"])
@pytest.mark.parametrize(("kind", "hidden"), [
    ("email", "jane.doe at example.com"), ("email", "jane42 at mail.example.org"), ("email", "jane at example dot com"),
    ("email", "jane [at] example [dot] com"), ("email", "jane.doe(at)mail(dot)example(dot)org"), ("email", "jane@ example.com"),
    ("email", "jane  AT  example DOT com"), ("phone", "+1 five five five 867 five three zero nine"),
    ("ip", "26 dot 198 dot 133 dot 150"), ("card", "4111 1111 1111 one one one one")])
def test_pii_disguises_do_not_depend_on_the_text_around(around, kind, hidden):
    text = around.format(hidden)
    a = text.index(hidden)
    assert (a, a + len(hidden)) in pii.find_disguised(text, pii.find_base(text))[kind], text


@pytest.mark.parametrize("text", ["look at example.com now", "Contact us at example.com", "sign-up at example.com, or e.g. at example.org",
                                  "Blog at WordPress.com."])
@pytest.mark.parametrize("around", ["{}", "É {}", "One polka dot. {}"])
def test_pii_words_before_a_host_are_prose(around, text):
    text = around.format(text)
    assert not any(pii.find_disguised(text, pii.find_base(text)).values())


def test_pii_cue_before_a_plain_name():
    text = "Please write to jane at example.com today"
    assert pii.find_disguised(text, pii.find_base(text))["email"] == [(16, 35)]
