"""Conversation structure repair by weighted CYK interval parsing.

A legal conversation's role initials are ``(s?(ua)+)?``. Each row is kept, given another
role, or deleted; rows without text may be inserted anywhere. The cheapest repair is a parse
of the rows by a weighted grammar in Chomsky normal form:

- Non-terminals are pairs of states of the language's automaton (0 nothing yet, 1 after the
  system row, 2 after a user row, 3 after an assistant row): ``N_pr`` derives what leads from
  p to r. Binary rules are ``N_pr -> N_pq N_qr``; a row is a terminal with its keep, re-role
  and delete weights; insertions are closed over once (``CLOSED``) and stand on both sides of
  every terminal.
- A span's cell holds, per non-terminal, the least (cost, audit). Of two different audits of
  one span and cost neither begins with the other (each letter costs the same in both), so
  the least audit of a whole is made of least audits of its parts.
- Spans combine bottom-up by length. As the rules join at a state, every split point of a
  span gives the same cell, so one split a span is tried and n rows need n - 1 combinations
  (``chart``), whatever the length of the conversation.

On Spark: rows are cut to keys, hashes of texts and flags, equal rows of a turn to a count,
and dealt by ranges of (conversation, turn, role, text hash), so a conversation of any length
is spread over tasks. Each task folds its part of a conversation into one cell; the parts'
cells combine in order. A second pass sorts the texts by conversation and streams them past
the audit: it holds one audit (a string as long as the conversation has rows, which is also
the result) and never a conversation's texts.

Edge cases: null role or text counts as one space; null conv_id is a conversation of its own;
rows of one turn go by role, then by a hash of the text; null turns come first; a role that
does not start with s, u or a is never kept; very long texts are hashed and streamed, never
gathered; repeated rows are duplicates; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ludex.session import ship_package

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FINAL = (0, 3)                       # states in which a conversation may end
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"

Cell = dict[tuple[int, int], tuple[int, str]]
EMPTY: Cell = {(p, p): (0, "") for p in range(4)}


def combine(x: Cell, y: Cell) -> Cell:
    """The cell of two neighbouring spans: the least (cost, audit) over the binary rules."""
    out: Cell = {}
    for (p, q), (cost_x, audit_x) in x.items():
        for r in range(4):
            right = y.get((q, r))
            if right is not None:
                cost = cost_x + right[0]
                held = out.get((p, r))
                if held is None or cost < held[0]:
                    out[p, r] = (cost, audit_x + right[1])
                elif cost == held[0]:
                    audit = audit_x + right[1]
                    if audit < held[1]:
                        out[p, r] = (cost, audit)
    return out


def _closure() -> Cell:
    """Cheapest insertions between any two states."""
    closed = dict(EMPTY)
    one = {(p, r): (INSERT, "I") for (p, initial), r in STEP.items() if initial in ROLES}
    while (more := _least(closed, combine(closed, one))) != closed:
        closed = more
    return closed


def _least(x: Cell, y: Cell) -> Cell:
    return {k: min(c[k] for c in (x, y) if k in c) for k in {**x, **y}}


CLOSED = _closure()


@lru_cache(maxsize=256)
def leaf(initial: str, forced: bool, truncated: bool, copies: int = 1) -> Cell:
    """The cell of one row (and of further copies of it, which must go), with insertions."""
    cell: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if not forced:
        extra = TRUNCATED if truncated else 0
        for (p, letter), r in STEP.items():
            if letter == initial:
                cell[p, r] = (KEEP + extra, "K")
            elif letter in ROLES:
                cell[p, r] = min(cell.get((p, r), (REROLE + extra, "R")), (REROLE + extra, "R"))
    cell = combine(combine(CLOSED, cell), CLOSED)
    if copies > 1:
        cell = combine(cell, {(p, p): (DELETE * (copies - 1), "D" * (copies - 1)) for p in range(4)})
    return cell


def chart(cells: list[Cell]) -> Cell:
    """The cell of the whole span, bottom-up: spans of 1, 2, 4, ... rows."""
    while len(cells) > 1:
        joined = [combine(cells[i], cells[i + 1]) for i in range(0, len(cells) - 1, 2)]
        cells = joined + cells[len(joined) * 2:]
    return cells[0] if cells else dict(EMPTY)


def cheapest(cell: Cell) -> tuple[int, str]:
    """Cost and audit of the best repair of a whole conversation."""
    return min(cell[0, r] for r in FINAL if (0, r) in cell)


def steps(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired rows (role, text): the audit applied to the rows in their order."""
    state = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = ROLES["a" if state == 2 else "u"]
        state = STEP[state, role[:1]]
        yield role, text


# ---------------------------------------------------------------------------------- Spark

_CODE = {pair: i for i, pair in enumerate((p, r) for p in range(4) for r in range(4))}
_FACTS = ("first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal")
_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def normalized(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) with nulls of role and text as one space."""
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.lit(1).alias("copies"))


def damage(rows: DataFrame) -> DataFrame:
    """The rows as the query's contract damages them; a dropped row stays with no copies, so
    that its conversation is reported."""
    own = normalized(rows)
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    own = own.withColumn("kind", F.crc32(key.cast("binary")) % 20)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return own.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                      text.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def _hashed(rows: DataFrame) -> DataFrame:
    """128 bits that stand for the text in keys and in the order of equal turns and roles."""
    return rows.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), "text"))


def analysed(rows: DataFrame) -> DataFrame:
    """Distinct rows without their texts: copies, initial, and whether blank, truncated, or
    a repetition of an earlier turn."""
    solid = F.translate("text", SPACE, "")
    real = F.col("copies") > 0
    own = _hashed(rows).select(
        "conv_id", *[F.when(real, F.col(c)).alias(c) for c in ("turn", "role", "h1", "h2")], "copies",
        (real & (solid == "")).alias("is_blank"), (real & ~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("is_truncated"))
    own = own.groupBy("conv_id", "turn", "role", "h1", "h2").agg(
        F.sum("copies").alias("copies"), F.max("is_blank").alias("is_blank"), F.max("is_truncated").alias("is_truncated"))
    keys = ["conv_id", "role", "h1", "h2"]
    again = (own.where("copies > 0").groupBy(*[F.col(k).alias(f"again_{k}") for k in keys])
                .agg(F.min(F.struct("turn")).alias("first"), F.max(F.struct("turn")).alias("last"))
                .where(~F.col("first.turn").eqNullSafe(F.col("last.turn"))))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"again_{k}")) for k in keys])
    later = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    return own.join(again, same, "left").select(*own.columns, later.alias("is_later"))


def _segments_schema(conv_type: pa.DataType) -> pa.Schema:
    return pa.schema([("conv_id", conv_type), ("part", pa.int32()), ("first_initial", pa.string()), ("last_initial", pa.string()),
                      *((f, pa.int64()) for f in _FACTS), ("codes", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())),
                      ("audits", pa.list_(pa.string()))])


class _Part:
    """What one task holds of a conversation: its cell and counts."""

    def __init__(self) -> None:
        self.cells: list[Cell] = []
        self.first_initial = self.last_initial = None
        self.first_turn = self.last_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, role, copies, is_blank, is_truncated, is_later) -> None:
        if copies < 1:
            return
        initial = role[:1]
        if is_blank:
            self.blank += copies
        else:
            self.duplicate += copies - 1 + is_later
            self.truncated += is_truncated and not is_later
        self.cells.append(leaf(initial, is_blank or is_later, is_truncated, copies))
        if len(self.cells) == 4096:
            self.cells = [chart(self.cells)]
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.illegal += (copies - 1) * _illegal(initial, initial) + (self.last_initial is not None and _illegal(self.last_initial, initial))
        self.first_initial = initial if self.first_initial is None else self.first_initial
        self.last_initial = initial

    def follow(self, other: _Part) -> None:
        """Append the next part of the same conversation."""
        self.cells = [combine(chart(self.cells), chart(other.cells))]
        if self.last_initial is not None and other.first_initial is not None:
            self.illegal += _illegal(self.last_initial, other.first_initial)
        self.turns -= self.last_turn is not None and self.last_turn == other.first_turn
        for f in ("turns", "blank", "duplicate", "truncated", "illegal"):
            setattr(self, f, getattr(self, f) + getattr(other, f))
        for mine, theirs in (("first_initial", "first_initial"), ("first_turn", "first_turn")):
            if getattr(self, mine) is None:
                setattr(self, mine, getattr(other, theirs))
        for name in ("last_initial", "last_turn"):
            if getattr(other, name) is not None:
                setattr(self, name, getattr(other, name))

    def report(self) -> dict:
        cost, audit = cheapest(chart(self.cells))
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
                "illegal": self.illegal, "cost": cost, "audit": audit}


def _illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000, text_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches, cut by number and by the length of their last column's texts."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[-1] or "")
        if len(held) == size or n >= text_bytes:
            yield _batch(held, schema)
            held, n = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(df.schema[name].dataType)


def _spark_schema(df: DataFrame, columns: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", df.schema["conv_id"].dataType)] + T.StructType.fromDDL(columns).fields)


def reports(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) per conversation of
    ``normalized`` or damaged rows."""
    ship_package(rows.sparkSession)
    conv_type = _arrow_type(rows, "conv_id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId()      # ranges are numbered in their order
        schema = _segments_schema(conv_type)

        def parts() -> Iterator[tuple]:
            part, held, any_row = _Part(), None, False
            for conv, *facts in _rows(batches):
                if any_row and conv != held:
                    yield dump(held, part)
                    part = _Part()
                held, any_row = conv, True
                part.add(*facts)
            if any_row:
                yield dump(held, part)

        def dump(conv, part: _Part) -> tuple:
            cell = chart(part.cells)
            return (conv, number, part.first_initial, part.last_initial, *(getattr(part, f) for f in _FACTS),
                    [_CODE[k] for k in cell], [c for c, _ in cell.values()], [a for _, a in cell.values()])

        yield from _batched(parts(), schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = {i: k for k, i in _CODE.items()}
        schema = pa.schema([("conv_id", conv_type), *((f, pa.int64()) for f in _REPORT), ("audit", pa.string())])

        def whole() -> Iterator[tuple]:
            total, held, any_row = None, None, False
            for conv, _, first, last, *rest in _rows(batches):
                part = _Part()
                part.first_initial, part.last_initial = first, last
                for name, value in zip(_FACTS, rest[:len(_FACTS)], strict=True):
                    setattr(part, name, value)
                codes, costs, audits = rest[len(_FACTS):]
                part.cells = [{pairs[c]: (n, a) for c, n, a in zip(codes, costs, audits, strict=True)}]
                if any_row and conv == held:
                    total.follow(part)
                    continue
                if any_row:
                    yield (held, *total.report().values())
                total, held, any_row = part, conv, True
            if any_row:
                yield (held, *total.report().values())

        yield from _batched(whole(), schema)

    order = ["conv_id", "turn", "role", "h1", "h2"]
    ranged = analysed(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    segments = ranged.select("conv_id", "turn", "role", "copies", "is_blank", "is_truncated", "is_later").mapInArrow(fold, _spark_schema(
        rows, "part int, first_initial string, last_initial string, " + ", ".join(f"{f} long" for f in _FACTS)
        + ", codes array<int>, costs array<long>, audits array<string>"))
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(
        join, _spark_schema(rows, ", ".join(f"{f} long" for f in _REPORT) + ", audit string"))


def _past_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's report (first) and its rows in order, in one partition each."""
    own = _hashed(rows.where("copies > 0")).select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role", "h1", "h2", "copies",
        *[F.lit(None).cast("long").alias(f) for f in _REPORT], F.lit(None).cast("string").alias("audit"), "text")
    heads = found.select("conv_id", F.lit(0).alias("kind"), *[F.lit(None).cast(own.schema[c].dataType).alias(c) for c in (
        "turn", "role", "h1", "h2", "copies")], *_REPORT, "audit", F.lit(None).cast("string").alias("text"))
    both = heads.unionByName(own).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "h1", "h2")
    return both.select("conv_id", "kind", "role", "copies", *_REPORT, "audit", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, report, audit, iterator of repaired rows); each must be read to its end."""
    feed = _rows(batches)
    row = next(feed, None)
    while row is not None:
        conv, report, audit = row[0], row[4:-2], row[-2]
        after = [None]

        def source(after=after) -> Iterator[tuple[str, str]]:
            for r in feed:
                if r[1] == 0:
                    after[0] = r
                    return
                for _ in range(r[3]):
                    yield r[2], r[-1]

        rows = source()
        yield conv, report, audit, steps(audit, rows)
        for _ in rows:                      # nothing is left but the end of the conversation
            pass
        row = after[0]


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations (conv_id, position, role, text) of ``normalized`` rows."""
    conv_type = _arrow_type(rows, "conv_id")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", conv_type), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])
        yield from _batched(((conv, i, role, text) for conv, _, _, repaired in _conversations(batches)
                             for i, (role, text) in enumerate(repaired)), schema)

    return _past_audits(rows, reports(rows)).mapInArrow(texts, _spark_schema(rows, "position long, role string, text string"))


def repair_digests(conversations: DataFrame) -> DataFrame:
    """The query's contract: each damaged conversation's report and the SHA-256 of its
    repaired ``role:text`` lines."""
    rows = damage(conversations)
    conv_type = _arrow_type(rows, "conv_id")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", conv_type), *((f, pa.int64()) for f in _REPORT), ("audit", pa.string()),
                            ("repaired_sha256", pa.string())])

        def whole() -> Iterator[tuple]:
            for conv, report, audit, repaired in _conversations(batches):
                sha = hashlib.sha256()
                for i, (role, text) in enumerate(repaired):
                    sha.update(f"{chr(10) if i else ''}{role}:{text}".encode())
                yield (conv, *report, audit, sha.hexdigest())

        yield from _batched(whole(), schema)

    return _past_audits(rows, reports(rows)).mapInArrow(
        digests, _spark_schema(rows, ", ".join(f"{f} long" for f in _REPORT) + ", audit string, repaired_sha256 string"))
