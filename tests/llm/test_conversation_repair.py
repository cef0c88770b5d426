"""Conversation repair against a search over all repairs, and against plain row-by-row code."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from ludex.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def search(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Cheapest (cost, audit) of (initial, forced, truncated) rows: Dijkstra over the number of
    rows used and the roles given so far, as the language needs to know them."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, tail = heapq.heappop(heap)
        if (at, tail) in seen:
            continue
        seen.add((at, tail))
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", tail):
            return cost, audit
        moves = []
        if at < len(rows):
            initial, forced, truncated = rows[at]
            moves.append((2, "D", 1, ""))
            if not forced:
                moves.append((5 * truncated, "K", 1, initial))
                moves += [(1 + 5 * truncated, "R", 1, x) for x in "ua"]
        moves += [(5, "I", 0, x) for x in "ua"]
        for price, letter, used, role in moves:
            new = tail + role
            if not re.fullmatch("s?(ua)*u?", new):
                continue
            new = re.sub("^(s?)(?:ua)+(?=ua)", r"\1", new)          # one pair tells as much as many
            new = re.sub("^(s?ua)(?:ua)*(u?)$", r"\1\2", new)
            heapq.heappush(heap, (cost + price, audit + letter, at + used, new))
    raise AssertionError


def plain(table: list[tuple]) -> list[tuple]:
    """The contract, conversation by conversation."""
    out = []
    for conv in dict.fromkeys(r[0] for r in table):
        rows = []
        for c, turn, role, text in table:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 1:
                text = ""
            if kind == 2:
                text = re.sub("[.!?]", "", text)
            if kind == 4:
                role = "user"
            rows += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        counts, facts, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, [], set()
        for _, role, text in rows:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            facts.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = search(facts)
        turns = [t for t, *_ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        lines = C.steps(audit, iter([(role, text) for _, role, text in rows]))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, sha))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def found(spark, table, n=3, schema=SCHEMA):
    df = C.repair_digests(spark.createDataFrame(table, schema).repartition(n))
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def test_cells_equal_the_search():
    rng = random.Random(5)
    for _ in range(400):
        rows = [(rng.choice("ssuuuaaaxt "), rng.random() < .2, rng.random() < .3) for _ in range(rng.randint(0, 9))]
        assert C.cheapest(C.chart([C.leaf(*r) for r in rows])) == search(rows)


def test_every_split_point_gives_the_same_cell():
    """The rules join at states, so the chart needs one split a span."""
    rng = random.Random(6)
    leaves = [C.leaf(rng.choice("suax"), rng.random() < .2, rng.random() < .3) for _ in range(9)]
    cells = {(i, i + 1): c for i, c in enumerate(leaves)}
    for size in range(2, 10):
        for i in range(10 - size):
            made = [C.combine(cells[i, k], cells[k, i + size]) for k in range(i + 1, i + size)]
            assert all(m == made[0] for m in made)
            cells[i, i + size] = made[0]
    assert cells[0, 9] == C.chart(leaves)


def test_insertions_are_used_where_they_are_cheap(monkeypatch):
    monkeypatch.setattr(C, "INSERT", 1)
    monkeypatch.setattr(C, "CLOSED", C._closure())
    C.leaf.cache_clear()
    try:
        cost, audit = C.cheapest(C.chart([C.leaf("u", False, False)]))
        assert (cost, audit) == (1, "KI")
        assert C.cheapest(C.chart([C.leaf("s", False, False), C.leaf("a", False, False)])) == (1, "KIK")
        assert list(C.steps("KIK", iter([("system", "x"), ("assistant", "y")]))) == [("system", "x"), ("user", ""), ("assistant", "y")]
    finally:
        C.leaf.cache_clear()


def test_query_equals_plain_code(spark):
    rng = random.Random(7)
    table = []
    for conv in range(60):
        for turn in range(rng.randint(1, 14)):
            if rng.random() < .1:
                continue
            role = rng.choice(["user", "assistant"]) if rng.random() < .3 else ["user", "assistant"][turn % 2]
            role = "system" if turn == 0 and rng.random() < .4 else role
            table.append((conv, turn, role, rng.choice(["Yes.", "No!", "so it", "A. B? c", "  \t", "end. \n", "é中."]) + rng.choice(["", "", " x."])))
    assert found(spark, table) == plain(table)


def test_edges(spark):
    table = [(1, None, "user", "a."), (1, 0, "user", "a."), (1, 3, "assistant", None), (1, 9, None, "b."),
             (None, 2, "user", "q?"), (None, 5, "assistant", "r."), (2, None, None, None),
             (3, 0, "tool", "x."), (3, 1, "", "y."), (3, 2, "user", "z" * 300_000 + ".")]
    assert found(spark, table) == plain(table)
    assert found(spark, []) == []
    wide = spark.createDataFrame([(*r, "clash", 1) for r in table], SCHEMA + ", kind string, copies int")
    assert sorted(map(tuple, C.repair_digests(wide).collect()), key=str) == sorted(plain(table), key=str)


def test_repeated_rows_and_dropped_conversations(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table = [(dropped, 0, "user", "gone.")] + [(5000, 1, "user", "same.")] * 40 + [(5000, 2, "assistant", "ok.")]
    got = found(spark, table)
    assert got == plain(table)
    assert got[0] == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_a_conversation_is_spread_over_tasks(spark):
    """One conversation with nearly all rows: parts of several tasks join to the same result."""
    rng = random.Random(8)
    table = [(1, t, rng.choice(["user", "assistant"]), f"t{rng.randint(0, 400)}" + rng.choice([".", ".", ""])) for t in range(1500)]
    table += [(2, t, "user", "hello.") for t in range(3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark, table, 7) == plain(table)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_repaired_rows_are_legal(spark):
    table = [(c, t, r, f"text {t}.") for c in range(6) for t, r in enumerate(["user", "user", "assistant", "system", "assistant"][: c + 1])]
    got = C.repair(C.normalized(spark.createDataFrame(table, SCHEMA))).orderBy("conv_id", "position").collect()
    for conv in {r.conv_id for r in got}:
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in got if r.conv_id == conv))


@pytest.mark.parametrize("initial", ["s", "u", "a", "x", " ", ""])
def test_leaf_without_text_must_go(initial):
    assert C.cheapest(C.leaf(initial, True, False)) == (2, "D")
