"""N-gram Jaccard self-join by adaptive multi-match prefixes.

A document's set: its distinct 5-word shingles (ASCII lower case; fewer words: the whole
sequence as one). Documents link at a Jaccard similarity of ``PERCENT`` / 100 or more.

Prefixes. Tokens have one global order: level, then hash. A first pass counts, exactly, how
many documents hold a token in their longest prefix by hash, a second one how many hold it
where that prefix reaches as tokens of the first go back; tokens held often get the level of
the higher count (in ``CELLS`` cells by hash, each with its highest level), all others level 0,
so what many documents share comes last. If two sets are similar enough, their prefixes of
``n - ceil(t n) + l`` tokens share at least ``l``. Each document picks the ``l`` with the
least estimated cost (entries its prefix meets, and the candidates that can meet it ``l``
times, each to be verified); a pair is verified only if it shares the smaller ``l`` of the
two. Any order and any ``l`` give the same links.

A pair must also share as many prefix tokens as its overlap needs beyond the rest: of the set
whose prefix ends first, all prefix tokens that match lie in the other's prefix, so sizes n and
m need ``t / (1 + t) (n + m)`` less the tokens behind that prefix (``least_shared``). With rare
tokens in front this leaves few pairs that are not similar.

No group is expanded into pairs. Equal sets are one class. Every document has a leader, of the
smallest documents of its prefix tokens' groups the one it shares most with; documents of one
leader are a group. Pairs of document and leader that share enough are verified from the texts,
which connects most of a group of near copies. What is left is joined completely, against
blocks: up to ``BLOCK`` documents of one group, of nearly equal set sizes, all verified with the
leader or none, are a block, whose prefix tokens are those of its members. A document that
shares enough of them is compared with the whole block, its own included, in one task, from the
texts (``linked_in_blocks``); a verified document needs no comparison with verified blocks of
its group. The task gives as many links as connect what it compared, not all pairs. A block
with many documents to compare is repeated, so that no task compares more than ``PROBES``.

Edge cases: null, empty or blank text has an empty set and links with nothing; rows that
share a doc_id are one document (any row's link is its link); rows without doc_id get
component null; very long texts are hashed whole, in a slice of their own; an empty table
gives no rows. Other columns are not read by the join; ``keep_one`` returns them as they are,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ludex.llm import text as X
from ludex.llm.components import connected_components
from ludex.session import materialize, ship_package

WIDTH = 5
PERCENT = 80
CELLS = 1 << 20             # cells of the level table: one byte each, whatever the input
OFTEN = 16                  # documents that hold a token before it has a level
CLASS_CELLS = 1 << 22       # bits that tell which prefixes to join with the classes
HOT_LEVEL = 14              # level of tokens whose rows are not gathered in one task
MAX_MATCH = 8               # largest l tried by the cost model
VERIFY_COST = 0.05          # cost of verifying, per token of the set, in prefix entries
CHANCE = 0.25               # holders that a token without level has by chance
BLOCK = 256                 # documents of a group compared at once
SIZE_BAND = 0.03            # members of a block have sizes within this logarithm
PROBES = 2048               # documents that one task compares with a block

_U = np.uint64


def document_sets(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Sorted distinct shingle hashes per row of a batch with a column ``text``."""
    for part, data, offsets in X.slices(batch):
        low = X.LOWER[data]
        starts, ends, rows = X.word_spans(low, offsets)
        hashes = X.span_hash(X.prefix_hash(low), starts, ends)
        values, owner = X.shingles(hashes, rows, part.num_rows, WIDTH)
        order = np.argsort(owner, kind="stable")
        cut = np.searchsorted(owner[order], np.arange(1, part.num_rows))
        yield part, [np.unique(v) for v in np.split(values[order], cut)]


def set_hashes(s: np.ndarray) -> tuple[int, int]:
    """Two order-free hashes of a set, as signed 64-bit numbers."""
    return (int(X.mix(s).sum(dtype=np.uint64).astype(np.int64)),
            int(X.mix(s * _U(0xD6E8FEB86659FD93) + _U(1)).sum(dtype=np.uint64).astype(np.int64)))


def longest_prefix(n: int) -> int:
    """Tokens of the longest prefix that the cost model may choose for ``n`` tokens."""
    need = -(-PERCENT * n // 100)
    return n - need + min(MAX_MATCH, need)


def reach(n: int, back: int) -> int:
    """How many of ``n`` tokens by hash the longest prefix comes to take from if ``back`` of its
    first ones go back. Hashes are even, so that share is expected of the next ones too."""
    size = longest_prefix(n)
    if back == size:
        return n
    return min(n, size + -(-5 * size * back // (4 * (size - back))))        # a quarter more than expected


def raised(levels: np.ndarray, tokens: DataFrame) -> np.ndarray:
    """The level table, raised to the bits of the highest sum of ``n`` among each cell's tokens
    where that is at least ``OFTEN``."""
    counts = tokens.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    cell = F.col("token").bitwiseAND(F.lit(CELLS - 1)).cast("int")
    levels = levels.copy()
    for r in counts.groupBy(cell.alias("cell")).agg(F.max("n").alias("n")).collect():       # at most CELLS rows
        levels[r.cell] = max(levels[r.cell], min(63, int(r.n).bit_length()))
    return levels


def first_levels(docs: DataFrame) -> np.ndarray:
    """The levels by the documents that hold a token in their longest prefix by hash alone."""
    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in document_sets(batch):
                if sets:
                    tokens, n = np.unique(np.concatenate([s[:longest_prefix(len(s))] for s in sets]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n)], names=["token", "n"])

    return raised(np.zeros(CELLS, dtype=np.uint8), docs.select("text").mapInArrow(least, "token long, n long"))


def set_table(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, late) of every row; h1 and h2 tell sets apart. ``late`` are
    the tokens that may come into its prefix as others went back by ``levels``: they were not
    counted yet."""
    raw_levels = levels.tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("late", pa.list_(pa.int64()))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of = np.frombuffer(raw_levels, dtype=np.uint8)
        for batch in batches:
            for part, sets in document_sets(batch):
                n, h1, h2, late = [], [], [], []
                for s in sets:
                    n.append(len(s))
                    a, b = set_hashes(s)
                    h1.append(a)
                    h2.append(b)
                    size = longest_prefix(len(s))
                    back = np.count_nonzero(level_of[(s[:size] % _U(CELLS)).astype(np.int64)])
                    late.append(s[size:reach(len(s), back)].view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(
                    (n, h1, h2, late), list(schema)[1:], strict=True))], schema=schema)

    return docs.mapInArrow(build, "doc_id long, n_shingles long, h1 long, h2 long, late array<long>")


def choose_prefix(tokens: np.ndarray, weight: np.ndarray) -> tuple[int, int]:
    """(l, prefix length) of least estimated cost for sorted tokens and their estimated
    numbers of other holders."""
    n = len(tokens)
    need = -(-PERCENT * n // 100)
    base = n - need
    most = min(MAX_MATCH, need)
    met = np.cumsum(weight[:base + most])[base:base + most]       # entries met for l = 1, 2, ...
    levels = np.arange(1, most + 1)
    cost = met + met / levels * (VERIFY_COST * n) + levels        # one written row per extra token
    best = int(np.argmin(cost)) + 1
    return best, base + best


def class_cells(classes: DataFrame) -> np.ndarray:
    """A bit per cell of h1, set where a class of equal sets lies: ``CLASS_CELLS`` bits,
    whatever the number of classes."""
    cell = F.col("h1").bitwiseAND(F.lit(CLASS_CELLS - 1))
    words = classes.groupBy(F.shiftright(cell, 3).cast("int").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1, int(h1 & 7))")).alias("bits")).collect()           # at most CLASS_CELLS / 8 rows
    cells = np.zeros(CLASS_CELLS // 8, dtype=np.uint8)
    for r in words:
        cells[r.at] = r.bits
    return cells


def prefix_table(docs: DataFrame, levels: np.ndarray, cells: np.ndarray) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, need, prefix, copied) of every row with a set; ``copied``
    is false where no other document can have an equal set."""
    raw_levels, raw_cells = levels.tobytes(), cells.tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()),
                        ("need", pa.int32()), ("prefix", pa.list_(pa.int64())), ("copied", pa.bool_())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of, held = np.frombuffer(raw_levels, dtype=np.uint8), np.frombuffer(raw_cells, dtype=np.uint8)
        for batch in batches:
            for part, sets in document_sets(batch):
                rows = []
                for doc, s in zip(part.column(0).to_pylist(), sets, strict=True):
                    if doc is None or not len(s):
                        continue
                    level = level_of[(s % _U(CELLS)).astype(np.int64)]
                    tokens = (level.astype(np.uint64) << _U(58)) | (s >> _U(6))
                    tokens.sort()
                    weight = 2.0 ** (tokens >> _U(58)).astype(float) - 1 + CHANCE
                    match, size = choose_prefix(tokens, weight)
                    h1, h2 = set_hashes(s)
                    cell = h1 & (CLASS_CELLS - 1)
                    rows.append((doc, len(s), h1, h2, match, tokens[:size].view(np.int64), bool(held[cell >> 3] >> (cell & 7) & 1)))
                cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return docs.mapInArrow(build, "doc_id long, n_shingles long, h1 long, h2 long, need int, prefix array<long>, copied boolean")


def shared_entries(reps: DataFrame, levels: np.ndarray) -> DataFrame:
    """(token, doc_id, n_shingles, need) of the prefix tokens that two rows or more hold: one
    shuffle of all. Tokens of a level from ``HOT_LEVEL`` on are counted with map-side combine
    and joined back from written tables, so that a hot one can be split."""
    rows = reps.select(F.explode("prefix").alias("token"), "doc_id", "n_shingles", "need")
    hot = F.shiftrightunsigned("token", 58) >= HOT_LEVEL
    usual = rows.where(~hot).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("n > 1").drop("n")
    if int(levels.max()) < HOT_LEVEL:
        return usual
    often = materialize(rows.where(hot), "hot-entries")
    shared = materialize(often.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("token"), "shared-hot-tokens")
    return usual.unionByName(often.join(shared, "token"))


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of documents (one pair per a) whose sets are similar enough, by their whole texts.
    Only texts of documents in a pair are shuffled where the list of these is small enough
    to be broadcast (by its size). Inputs are plain scans, so a hot side can be split."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sides = []
                for c in ("ta", "tb"):
                    column = part.column(part.schema.get_field_index(c)).dictionary_encode()
                    one = pa.RecordBatch.from_arrays([column.dictionary], names=["text"])
                    sets = [s for _, found in document_sets(one) for s in found]
                    sides.append([sets[i] for i in column.indices.to_pylist()])
                keep = []
                for x, y in zip(*sides, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], schema=schema).filter(pa.array(keep, pa.bool_()))

    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    ids = materialize(ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), "documents-in-pairs")
    docs = materialize(docs.join(ids, "doc_id", "left_semi"), "texts-in-pairs")
    ta = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    tb = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def _may_link(n: str, m: str):
    return (F.col(n) * 100 >= F.col(m) * PERCENT) & (F.col(m) * 100 >= F.col(n) * PERCENT)


def least_shared(n, n_need, m, m_need):
    """Least number of prefix tokens that sets of sizes ``n`` and ``m`` share if they are
    similar enough and their prefixes were chosen for ``n_need`` and ``m_need`` tokens."""
    behind = lambda size, need: F.ceil(size * PERCENT / 100) - need
    overlap = F.ceil((n + m) * PERCENT / (100 + PERCENT))
    return F.greatest(F.least(n_need, m_need), overlap - F.greatest(behind(n, n_need), behind(m, m_need)))


def join_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row."""
    ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    levels = first_levels(docs)
    sets = materialize(set_table(docs, levels), "sets")
    levels = raised(levels, sets.select(F.explode("late").alias("token"), F.lit(1).alias("n")))
    real = sets.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).drop("late")
    # Equal sets: one class, represented by its smallest document.
    classes = (real.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
                   .where("n > 1").select("h1", "h2", "n_shingles", "rep"))
    classes = materialize(classes, "classes")
    member = materialize(real.join(classes, ["h1", "h2", "n_shingles"]).where("doc_id <> rep")
                             .select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), "class-links")
    # Only prefixes of sets that may have an equal one are joined with the classes.
    prefixes = materialize(prefix_table(docs, levels, class_cells(classes)), "prefixes")
    first = prefixes.where("copied").join(classes, ["h1", "h2", "n_shingles"], "left").where(F.col("rep").isNull() | (F.col("rep") == F.col("doc_id")))
    columns = ["doc_id", "n_shingles", "need", "prefix"]
    reps = prefixes.where("not copied").select(columns).unionByName(first.select(columns))
    entries = materialize(shared_entries(reps, levels), "entries")
    pairs = materialize(leader_pairs(entries), "leader-pairs")
    led = materialize(verified(pairs.where("shared >= enough").select("a", "b"), docs), "leader-links")
    links = member.unionByName(led).unionByName(linked_in_blocks(entries, groups_of(entries, pairs, led), docs))
    components = connected_components(links)
    own = _with_component(sets.select("doc_id", "n_shingles"), materialize(components, "final-components"))
    return own.select("doc_id", "n_shingles", F.col("comp").alias("component_id"))


def groups_of(rows: DataFrame, pairs: DataFrame, led: DataFrame) -> DataFrame:
    """(doc_id, comp, sure) of every document of ``rows``: its leader, or itself, and whether
    that link is verified."""
    sure = led.select(F.col("a").alias("sa"), F.lit(True).alias("sure")).distinct()
    leader = pairs.select("a", F.col("b").alias("comp")).join(sure, F.col("a") == F.col("sa"), "left").drop("sa")
    ids = rows.select("doc_id").distinct().join(leader, F.col("doc_id") == F.col("a"), "left")
    known = F.col("comp").isNull() | F.coalesce("sure", F.lit(False))
    return materialize(ids.select("doc_id", F.coalesce("comp", "doc_id").alias("comp"), known.alias("sure")), "groups")


def _with_component(rows: DataFrame, components: DataFrame) -> DataFrame:
    return (rows.join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left")
                .withColumn("comp", F.coalesce("component", "doc_id")).drop("component"))


def leader_pairs(rows: DataFrame) -> DataFrame:
    """(a, b, shared, enough), at most one per document: itself and the leader it shares most
    prefix tokens with, how many, and how many it takes to be similar. A token's leader is the
    smallest document that holds it."""
    leaders = (rows.groupBy("token").agg(F.min(F.struct("doc_id", "n_shingles", "need")).alias("l"))
                   .select("token", F.col("l.doc_id").alias("leader"), F.col("l.n_shingles").alias("leader_n"), F.col("l.need").alias("leader_need")))
    leaders = materialize(leaders, "leaders")
    enough = least_shared(F.col("n_shingles"), F.col("need"), F.col("leader_n"), F.col("leader_need"))
    near = (rows.join(leaders, "token").where((F.col("doc_id") != F.col("leader")) & _may_link("n_shingles", "leader_n"))
                .groupBy("doc_id", "leader").agg(F.count(F.lit(1)).alias("shared"), F.min(enough).alias("enough")))
    best = near.groupBy("doc_id").agg(F.max(F.struct("shared", (-F.col("leader")).alias("order"), "leader", "enough")).alias("m"))
    return best.select(F.col("doc_id").alias("a"), F.col("m.leader").alias("b"), "m.shared", "m.enough")


def block_probes(rows: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, block, sure) of the blocks' members, and (doc_id, block) of the documents to
    compare with a block: one as large as their own or larger (ties: of no smaller id)."""
    members = rows.groupBy("doc_id").agg(F.min("need").alias("need"), F.min("n_shingles").alias("n_least"), F.max("n_shingles").alias("n_most"))
    members = members.join(groups, "doc_id").withColumn("band", F.floor(F.log(F.col("n_most")) / SIZE_BAND).cast("int"))
    members = materialize(members, "members")
    kinds = materialize(members.groupBy("comp", "band", "sure").agg(F.count(F.lit(1)).alias("size")), "block-sizes")
    part = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("size") / BLOCK))
    members = members.join(kinds, ["comp", "band", "sure"]).withColumn("block", F.xxhash64("comp", "band", "sure", part))
    members = materialize(members.select("doc_id", "block", "comp", "sure", "size", "need", "n_least", "n_most"), "block-members")
    blocks = members.groupBy("block").agg(F.min("need").alias("block_need"), F.min("n_least").alias("least"), F.max("n_most").alias("most"),
                                          F.first("comp").alias("block_comp"), F.first("sure").alias("block_sure"), F.first("size").alias("block_size"))
    held = rows.select("token", "doc_id", "n_shingles", "need").join(
        members.select("doc_id", "size", F.col("block").alias("own"), "comp", "sure"), "doc_id")
    held = materialize(held, "block-rows")
    postings = materialize(held.select("token", F.col("own").alias("block")).distinct().join(blocks, "block"), "block-postings")
    ahead = (F.col("size") < F.col("block_size")) | ((F.col("size") == F.col("block_size")) & (F.col("own") <= F.col("block")))
    known = F.col("sure") & F.col("block_sure") & (F.col("comp") == F.col("block_comp"))
    # Member sizes that could link, and the fewest shared tokens over these sizes (at one end).
    n, need = F.col("n_shingles"), F.col("need")
    low = F.greatest(F.col("least"), F.ceil(n * PERCENT / 100))
    high = F.least(F.col("most"), F.floor(n * 100 / PERCENT))
    enough = F.least(*[least_shared(n, need, m, F.col("block_need")) for m in (low, high)])
    alone = (F.col("own") == F.col("block")) & (F.col("size") == 1)
    probes = (held.join(postings, "token").where(ahead & ~known & ~alone & (low <= high))
                  .groupBy("doc_id", "block").agg(F.count_distinct("token").alias("shared"), F.min(enough).alias("enough"))
                  .where("shared >= enough").select("doc_id", "block"))
    return members.select("doc_id", "block", "sure"), materialize(probes, "block-probes")


def linked_in_blocks(rows: DataFrame, groups: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that, with the verified ones of the groups, connect all documents that are
    connected by links."""
    members, probes = block_probes(rows, groups)
    copies = materialize(probes.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / PROBES).cast("int").alias("copies")), "block-copies")
    copy = F.explode(F.sequence(F.lit(0), F.col("copies") - 1))
    # kind 0 and 1: a member of a verified and of another block; 2: to be compared with it.
    inside = members.join(copies, "block").select("doc_id", "block", copy.alias("copy"), F.when(F.col("sure"), 0).otherwise(1).alias("kind"))
    outside = probes.join(copies, "block").select("doc_id", "block", F.pmod(F.xxhash64("doc_id"), "copies").cast("int").alias("copy"), F.lit(2).alias("kind"))
    places = materialize(inside.unionByName(outside), "block-places")
    ids = materialize(places.select("doc_id").distinct(), "documents-in-blocks")
    texts = materialize(docs.join(ids, "doc_id", "left_semi").distinct(), "texts-in-blocks")
    return (places.join(texts, "doc_id").select("block", "copy", "kind", "doc_id", "text").repartition("block", "copy")
                  .sortWithinPartitions("block", "copy", "kind").mapInArrow(_compare_blocks, "a long, b long"))


class _Block:
    """A block's sets as one sorted token list with owners, and which members are connected."""

    def __init__(self) -> None:
        self.docs: list[int] = []
        self.sets: list[np.ndarray] = []
        self.sure = False
        self.tokens = None

    def add(self, doc: int, tokens: np.ndarray, sure: bool) -> None:
        self.docs.append(doc)
        self.sets.append(tokens)
        self.sure = sure

    def close(self) -> None:
        self.size = np.array([len(s) for s in self.sets], dtype=np.int64)
        owner = np.repeat(np.arange(len(self.sets)), self.size)
        tokens = np.concatenate(self.sets) if self.sets else np.zeros(0, _U)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], owner[order]
        self.place = {d: i for i, d in enumerate(self.docs)}
        self.up = [self.place[d] for d in self.docs]               # rows of one id are one document
        if self.sure:
            self.up = [0] * len(self.docs)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def links(self, doc: int, own: np.ndarray) -> list[int]:
        """Similar members, one of each connected part; these are connected from now on."""
        if self.tokens is None:
            self.close()
        lo, hi = np.searchsorted(self.tokens, own, "left"), np.searchsorted(self.tokens, own, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(self.owner[at], minlength=len(self.sets))
        out, me = [], self.place.get(doc)
        roots = set() if me is None else {self.root(me)}
        for i in np.flatnonzero(100 * both >= PERCENT * (self.size + len(own) - both)).tolist():
            r = self.root(i)
            if self.docs[i] != doc and r not in roots:
                roots.add(r)
                out.append(self.docs[i])
        first, *rest = roots or [0]
        for r in rest:
            self.up[r] = first
        return out


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, copy, kind, doc_id, text), sorted: a block's members, then what to compare
    with them."""
    held, block = None, _Block()
    for batch in batches:
        for part, found in document_sets(batch):
            a, b = [], []
            for at, copy, kind, doc, own in zip(*(part.column(i).to_pylist() for i in range(4)), found, strict=True):
                if (at, copy) != held:
                    held, block = (at, copy), _Block()
                if kind < 2:
                    block.add(doc, own, kind == 0)
                    continue
                near = block.links(doc, own)
                a += [doc] * len(near)
                b += near
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each component the smallest document stays,
    once. Documents without an id stay."""
    found = join_components(docs)
    keep = materialize(found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__id")).distinct(), "kept")
    own = docs.join(keep, docs["doc_id"] == keep["__id"], "left_semi").dropDuplicates(["doc_id"])
    return own.unionByName(docs.where(F.col("doc_id").isNull()))
