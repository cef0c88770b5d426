"""Archives and packing, and the pipeline as a whole."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from ludex.llm import line_templates, packing, warc

from . import fixtures as X

PAGES = "page_id long, url string, html string"


def pages() -> list[tuple]:
    big = "<p>" + "long " * 4000
    return [(1, "http://a/x?y=1", "<html>é</html>"), (2, None, "same"), (3, "http://b/ \r\nX: y", "same"), (4, "u", None), (5, "u", ""),
            (6, "u", big), (7, "v", big), (7, "v", big), (None, "n", "same"), (None, "n", "alone"), (9, "", "a\r\n\r\nb\r\n\r\n")]


def sha(text: str | None) -> str:
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute_warc(rows, least: int) -> list[tuple]:
    top: dict = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", i))
    out = []
    for i, _, h in rows:
        n = len((h or "").encode())
        keep = top.get(h or "") if n >= least else None
        revisit = keep is not None and i != keep
        out.append((i, n, sha(h), "revisit" if revisit else "response", keep if revisit else None))
    return out


@pytest.mark.parametrize("least", [0, 10])
def test_warc_round_trip(spark, least):
    frame = X.frame(spark, pages(), PAGES).withColumn("offset", F.lit("clash")).withColumn("sha", F.lit("clash"))
    got = warc.round_trip(frame, min_revisit_bytes=least, archive_bytes=9000).collect()
    assert sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(
        map(str, brute_warc(pages(), least)))


def test_warc_selected_records_and_files(spark):
    index = warc.write_archives(X.frame(spark, pages(), PAGES), archive_bytes=5000)
    some = warc.read_records(index.where("page_id in (1, 9, 6)")).collect()
    html = {i: h for i, _, h in pages()}
    assert {r.page_id: r.payload for r in some if r.record_type == "response"} == {
        i: html[i].encode() for i in (1, 9)}
    # The archives are whole: records lie end to end.
    for r in index.groupBy("archive").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect():
        system, path = warc.open_folder(r.archive)
        assert system.get_file_info(path).size == r.n == r.end
    assert warc.round_trip(X.frame(spark, [], PAGES)).count() == 0


def test_ranges_coalesce_by_gap_and_size():
    assert warc.coalesce_ranges([0, 10, 50, 60], [10, 10, 5, 100], gap=20, limit=40) == [(0, 2, 0, 20), (2, 3, 50, 55), (3, 4, 60, 160)]
    assert warc.coalesce_ranges([], []) == []


# ------------------------------------------------------------------ packing

def check_packing(rows, got, capacity=2048):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for i, text, *_ in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for s in range(0, len(ids), capacity):
            piece = ids[s:s + capacity]
            want[i, s, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= capacity
    return sum(r.length for r in got) / (capacity * max(1, len(bins)))


def test_packing_matches_the_library(spark):
    rng = random.Random(3)
    rows = X.documents(extra=["word | mark |x| y|", "<|startoftext|> a<|endoftext|>b", "İstanbul ΣΑΣ. ΟΔΟΣ", "q " * 2047, "q " * 2048,
                              "tok " * 9000, *(X.prose(rng, 150) for _ in range(60))])
    rows += [rows[-1], (None, "no id", None, None, None)]
    got = packing.pack(X.with_clashes(X.frame(spark, rows)), group_docs=1000).collect()
    assert check_packing(rows, got) > 0.85
    assert check_packing(rows, packing.pack(X.frame(spark, rows), group_docs=10).collect()) > 0.6
    assert packing.pack(X.frame(spark, [])).count() == 0


def test_packing_spreads_equal_rows_over_groups(spark):
    """Rows without id, repeated rows and their full pieces: no group takes them all."""
    rows = [(None, "", None, None, None)] * 200 + [(7, "same text", "en", "s", 9)] * 200 + [(8, "q " * 2100, "en", "s", 1)] * 40
    got = packing.pack(X.frame(spark, rows), group_docs=20).collect()
    check_packing(rows, got)
    groups = collections.Counter((r.doc_id, r.length == 2048, r.sequence_id >> 32) for r in got)
    assert max(n for (i, _, _), n in groups.items() if i != 8) < 60
    assert max(n for (i, full, _), n in groups.items() if i == 8 and full) < 20


def test_chunk_cache_takes_little_memory():
    tok = packing.ChunkTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(5)
    raw = np.frombuffer(" ".join(f"{rng.getrandbits(28):x}" for _ in range(60_000)).encode(), dtype=np.uint8)
    arrow = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        tok.rows(raw, np.array([0, len(raw)]))
        held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    finally:
        tracemalloc.stop()
    assert held < 60_000 * 100


def test_chunk_cache_is_bounded_and_exact(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 50)
    tok = packing.ChunkTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(6)
    for k in range(40):
        special = ["<|endoftext|>", "a|b", "|", "x" * 80, "É<S>", "end. Of"]
        text = " ".join([X.prose(rng, 30), *rng.sample(special, k % 4), X.prose(rng, 3)]) if k % 9 else " \n"
        want = tok.tok.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tok.ids(text), dtype="<u4").tolist() == want
        assert len(tok.cache.keys) == len(tok.cache.ids) <= 50
    assert tok.ids("") == b""


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_decreasing_matches_plain_search(lengths):
    sizes = np.array(lengths, dtype=np.int64)
    bins, offsets = packing.first_fit_decreasing(sizes, 50)
    used: list[int] = []
    for i in np.argsort(-sizes, kind="stable"):
        b = next((k for k, u in enumerate(used) if u + sizes[i] <= 50), len(used))
        if b == len(used):
            used.append(0)
        assert (bins[i], offsets[i]) == (b, used[b])
        used[b] += sizes[i]


# ------------------------------------------------------------------ pipeline

def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(12)
    item = " ".join(X.prose(rng, 25).split())
    rows, labels = [], []
    for i in range(160):
        good = i % 5 != 0
        text = X.prose(rng, rng.choice([60, 150, 300]))
        if good and i % 10 == 1:
            text = text + "\n" + "This notice is found in every one of them"
        if not good:
            text = " ".join(w + "***" for w in text.split())
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), 0))
    words = rows[1][1].split()
    rows.append((900, " ".join(words[:-1] + ["changed"]), "en", "s", 1))
    rows.append((901, rows[2][1], "en", "s", 1))
    rows.append((902, X.prose(rng, 80) + "\n" + item + "\n" + X.prose(rng, 80), "en", "s", 1))
    X.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    X.frame(spark, labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    bad = {i for i, q, _ in labels if not q}
    everyone = {r[0] for r in rows}
    assert set(seen["quality classifier"]) == everyone - bad
    assert set(seen["line dedup"]) == everyone - bad
    notice = sum(1 for i, q, _ in labels if q and i % 10 == 1)
    dropped = sum("This notice" not in seen["line dedup"][i] for i, q, _ in labels if q and i % 10 == 1)
    assert dropped == notice >= line_templates.LONG_DOCS      # too long to repeat by chance, in documents unlike each other
    assert set(seen["n-gram Jaccard join"]) == everyone - bad - {900, 901}
    assert set(seen["benchmark decontamination"]) == everyone - bad - {900, 901, 902}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    check_packing([(i, t) for i, t in seen["benchmark decontamination"].items()], packed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


def test_pipeline_drops_planted_notices(spark):
    """A long line goes from 3 unlike documents on, and a short one from 20 on, also where it
    is most of a text; copies and near copies stay whole for the Jaccard join."""
    rng = random.Random(21)
    def line(n): return " ".join(X.prose(rng, n).split())
    long_notice, short_notice, block = line(60), "Please read our terms of use today", [line(55) for _ in range(2)]
    own = {i: X.prose(rng, 80) for i in range(5)}
    rows = [(i, f"{own[i]}\n{long_notice}", "en", "s", 1) for i in range(5)]
    rows += [(10, f"tiny own text\n{long_notice}", "en", "s", 1), (11, long_notice, "en", "s", 1)]
    rows += [(100 + i, f"{short_notice}\n{X.prose(rng, 40)}", "en", "s", 1) for i in range(25)] + [(130, f"{short_notice}\nown bit", "en", "s", 1)]
    copy = "\n".join([*block, X.prose(rng, 400)])
    rows += [(200 + i, copy, "en", "s", 1) for i in range(4)]
    near = [line(55), *[line(8) for _ in range(40)]]
    rows += [(300 + i, "\n".join([*near, line(8)]), "en", "s", 1) for i in range(6)]
    rows += [(None, None, None, None, None), (400, "", "en", "s", 0)]
    out = dict(corpus_pipeline.STAGES)["line dedup"](spark, X.with_clashes(X.frame(spark, rows)), "")
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    assert [got[i].text for i in range(5)] == [own[i] for i in range(5)] and got[0].n_chars == len(own[0])
    assert got[10].text == "tiny own text" and got[11].text == "" and got[130].text == "own bit"
    assert not any(short_notice in got[100 + i].text for i in range(25))
    assert all(got[i].text == text[i] for i in (*range(200, 204), *range(300, 306), None, 400))


def test_pipeline_drops_leaks_of_masked_items(spark, tmp_path):
    """Items that hold nothing but numbers, units and a few words have no usable window; with
    other values they go too, and items of one word delete nothing."""
    items = [(1, "What is 12 + 7?"), (2, "Convert 5 km to miles and 3 feet to inches"), (3, "12 13 14 15 16 17 18 19 20 21"), (None, "2 + 2 = 4"),
             (4, None), (5, ""), (6, "Yes"), (7, "12")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leaky = ["Q: what is 12 + 7? A: 19", "Now convert 5 km to miles and 3 FEET to inches.", "11 12 13 14 15 16 17 18 19 20 21 22", "So 2 + 2 = 4, they say",
             "Q: what is 12 + 8? A: 20", "Now convert 6 km to miles and 3 feet to inches."]
    clean = ["What is 12 - 7?", "12 13 14 15 16 17 18 19 20 22 21", "So 2 + 3 = 5", "yes", "12", "Yes, it has 12 of them", "", None]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(leaky + clean)] + [(None, leaky[0], "en", "s", 1), (0, clean[0], "en", "s", 1)]
    docs = X.with_clashes(X.frame(spark, rows))
    out = dict(corpus_pipeline.STAGES)["benchmark decontamination"](spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == sorted([(0, clean[0]), *((len(leaky) + i, t or "") for i, t in enumerate(clean))])
