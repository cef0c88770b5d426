"""Exact removal of repeated substrings with per-shard suffix arrays.

Every byte covered by a 100-byte string that also starts earlier (smaller document, or
earlier in the same one) is removed. Strings never cross documents.

1. Anchors. Each 100-byte string is filed under its minimizer: the ``GRAM``-byte gram of
   least hash in it (ties: the rightmost). Equal strings have equal anchors, so all copies
   of a string meet under one anchor; the strings of one anchor position start in one run.
   Anchors met once in the corpus hold no repeat and stop there.
2. Copies. Of equal whole texts all but the first lose everything (a text of 100 bytes or
   more is covered by its strings) and are not filed: the first has all their strings. Runs of equal bytes (64-bit hash of the run besides that
   of its anchor) are pre-aggregated: the earliest stands for them, and all strings of the
   others repeat. Equality rests on 128 bits of hash there: for n runs two different ones are
   taken as equal with a probability under n^2 / 2^129 (10^-15 for 10^12 runs).
3. Shards. The bytes of the runs that stand, where an anchor has different ones, go to the
   shard of their anchor; an anchor with more than ``SHARD_RUNS`` runs is split over several
   shards. A shard's suffixes are
   sorted by Larsson-Sadakane refinement (only groups still tied are sorted again, by the
   ranks one prefix length further on), common prefixes of neighbours come from Kasai's
   algorithm, and of the suffixes that share 100 bytes all but the earliest are repeats.
4. Merging. Of a split anchor each shard sends its earliest strings, sorted. They are dealt in
   ranges of (anchor, string), so no task gathers an anchor's strings; inside a range the
   shards' sorted runs are merged one after the other by binary search (``Merge``), bytes
   compared, and of each string's owners all but the earliest are repeats.
5. The repeats' byte intervals are united per document, and the rest is hashed.

Edge cases: null text is empty; a text under 100 bytes loses nothing; rows that repeat
doc_id and text are one document (each row gets its result); rows that only share a doc_id
are ordered by a hash of their texts; rows without doc_id come before all others; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ludex.llm import text as X
from ludex.session import materialize, ship_package

LENGTH = 100
GRAM = 24
SHARD_RUNS = 4096            # runs of one anchor in one shard
CHUNK_BYTES = 1 << 20        # shards are sorted together up to this many bytes
BATCH_ROWS = 20_000          # rows of a result batch
SCAN_BYTES = 1 << 17         # text scanned for anchors at once: its arrays stay in the processor's cache
SEGMENT_BYTES = 1 << 20      # run bytes of a batch
_BITS = 21                   # positions of a chunk
NO_ID = -(1 << 63)
_U = np.uint64


# ------------------------------------------------------------------------- anchors

def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by windows of doubling width."""
    known = 1
    while known < width:
        step = min(known, width - known)
        values = np.minimum(values[:-step], values[step:])
        known += step
    return values


def anchor_runs(data: np.ndarray, prefix: np.ndarray, length: int = LENGTH,
                gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor position, first start, last start) of the runs of ``length``-byte
    strings in one piece of at most 2**21 bytes."""
    if len(data) < length:
        z = np.zeros(0, dtype=np.int64)
        return z.astype(np.uint64), z, z, z
    at = np.arange(len(data) - gram + 1)
    hashes = X.window_hash(prefix, gram)
    low = _U((1 << _BITS) - 1)
    packed = (hashes & ~low) | (low - at.astype(np.uint64))
    least = sliding_min(packed, length - gram + 1)
    place = (low - (least & low)).astype(np.int64)
    turn = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([turn[1:], [len(place)]]) - 1
    return hashes[place[turn]], place[turn], turn, last


def pieces(size: int, limit: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Byte ranges of a text whose strings' starts split it exactly."""
    return [(lo, min(size, lo + limit + length - 1)) for lo in range(0, max(size - length + 1, 1), limit)]


def file_anchors(docs: DataFrame) -> DataFrame:
    """(fp, run, id, dup, first, size): a run of strings first .. first + size - 1 under an
    anchor, and the hash of its bytes."""
    schema = pa.schema([("fp", pa.int64()), ("run", pa.int64()), ("id", pa.int64()), ("dup", pa.int32()), ("first", pa.int64()), ("size", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in X.slices(batch, limit=SCAN_BYTES):
                ids, dups = part.column(0).to_numpy(), part.column(1).to_numpy()
                if part.num_rows == 1:        # one text, perhaps a very long one
                    cuts = [(lo, data[lo:hi], np.array([0, hi - lo])) for lo, hi in pieces(len(data), 1 << 20)]
                else:
                    cuts = [(0, data, offsets)]
                for lo, piece, bounds in cuts:
                    fp, run, rows, first, size = text_runs(piece, bounds)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(fp.view(np.int64)), pa.array(run.view(np.int64)), pa.array(ids[rows]), pa.array(dups[rows]),
                         pa.array(first + lo), pa.array(size.astype(np.int32))], schema=schema)
            pa.default_memory_pool().release_unused()

    return docs.select("id", "dup", "text").mapInArrow(scan, "fp long, run long, id long, dup int, first long, size int")


def text_runs(data: np.ndarray, offsets: np.ndarray):
    """(fp, run hash, row, first, size) of the runs of several texts laid end to end, cut
    where strings would cross texts."""
    prefix = X.prefix_hash(data)
    fp, place, first, last = anchor_runs(data, prefix)
    row = np.searchsorted(offsets, place, side="right") - 1       # the text the anchor lies in
    first = np.maximum(first, offsets[row])
    last = np.minimum(last, offsets[row + 1] - LENGTH)
    ok = first <= last
    fp, row, first, last = fp[ok], row[ok], first[ok], last[ok]
    run = X.mix(X.span_hash(prefix, first, last + LENGTH) + (last - first).astype(np.uint64))
    return fp, run, row, first - offsets[row], last - first + 1


# ------------------------------------------------------------------------- shards

def suffix_order(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """``starts`` sorted by the ``length`` bytes from each. Larsson-Sadakane: ranks by the
    first 5 bytes, then ranks by twice the length from pairs of ranks, where only groups
    that are still tied are sorted again."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(length + 8, dtype=np.uint8)]).astype(np.uint64)
    shift = _U(_BITS)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(5):
        key = (key << _U(8)) | padded[k:n + k]
    order = np.sort((key << shift) | np.arange(n, dtype=np.uint64))
    low = _U((1 << _BITS) - 1)
    sa = (order & low).astype(np.int64)
    heads = np.concatenate([[True], (order[1:] >> shift) != (order[:-1] >> shift)])
    rank = np.zeros(n + length, dtype=np.int64)          # beyond the end: rank 0, below all
    rank[sa] = np.maximum.accumulate(np.where(heads, np.arange(n), 0)) + 1
    known = 5
    while known < length:
        step = min(known, length - known)
        # Slots of sa in groups of two and more.
        tied = np.flatnonzero(~(heads & np.concatenate([heads[1:], [True]])))
        if not len(tied):
            break
        p = sa[tied]
        order = np.sort((rank[p].astype(np.uint64) << _U(2 * _BITS + 1)) | (rank[p + step].astype(np.uint64) << shift)
                        | p.astype(np.uint64))
        sa[tied] = (order & low).astype(np.int64)
        new = np.concatenate([[True], (order[1:] >> shift) != (order[:-1] >> shift)])
        heads[tied] = new
        rank[sa[tied]] = np.maximum.accumulate(np.where(new, tied, 0)) + 1
        known += step
    wanted = np.zeros(n, dtype=bool)
    wanted[starts] = True
    return sa[wanted[sa]]


def common_prefixes(data: np.ndarray, order: np.ndarray, lanes: np.ndarray, widths: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Kasai: the common prefix (at most ``length``) of each suffix of ``order`` with its
    predecessor. Text order runs within lanes (start, number of suffixes), all lanes at
    once: the next suffix of a lane keeps all but one byte of its prefix, as long as the
    predecessor's next suffix is in the order too. Bytes are compared eight at a time."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(length + 16, dtype=np.uint8)])
    word = np.zeros(n + length + 8, dtype=np.uint64)
    for k in range(8):
        word |= padded[k:n + length + 8 + k].astype(np.uint64) << _U(8 * k)
    before = np.full(n + 1, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    slot = np.full(n + 2, n, dtype=np.int64)              # place in the order; n: not in it
    slot[order] = np.arange(len(order))
    out = np.zeros(n, dtype=np.int64)
    h = np.zeros(len(lanes), dtype=np.int64)
    previous = np.full(len(lanes), -2, dtype=np.int64)
    for t in range(int(widths.max()) if len(widths) else 0):
        live = np.flatnonzero(widths > t)
        p = lanes[live] + t
        q = before[p]
        kept = (previous[live] >= 0) & (slot[previous[live] + 1] < slot[p])
        g = np.where(kept, np.maximum(h[live] - 1, 0), 0)
        g[q < 0] = 0
        work = np.flatnonzero(q >= 0)
        while len(work):
            x = word[p[work] + g[work]] ^ word[q[work] + g[work]]
            lowest = x & (~x + _U(1))
            same = np.where(x == 0, 8, np.log2(np.maximum(lowest, _U(1)).astype(np.float64)).astype(np.int64) // 8)
            g[work] = np.minimum(g[work] + same, length)
            work = work[(same == 8) & (g[work] < length)]
        out[p] = g
        h[live] = g
        previous[live] = q
    return out[order]


def repeats(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs' bytes in document order: (segment, start, is a repeat) of every suffix.
    Equal strings have one anchor, so a chunk may hold many anchors."""
    sizes = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
    data = np.frombuffer(b"".join(segments), dtype=np.uint8)
    lanes = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    widths = sizes - (LENGTH - 1)
    owner = np.repeat(np.arange(len(segments)), widths)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(widths) - widths, widths)
    starts = lanes[owner] + inside
    order = suffix_order(data, starts)
    lcp = common_prefixes(data, order, lanes, widths)
    heads = np.flatnonzero((lcp < LENGTH) | (np.arange(len(order)) == 0))
    earliest = np.minimum.reduceat(order, heads) if len(order) else order
    repeat = np.ones(len(data) + 1, dtype=bool)
    repeat[earliest] = False
    return owner, inside, repeat[starts]


INTERVALS = "id long, dup int, lo long, hi long, fp long, shard int, shards int, string binary"
_INTERVALS = pa.schema([("id", pa.int64()), ("dup", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("fp", pa.int64()),
                        ("shard", pa.int32()), ("shards", pa.int32()), ("string", pa.binary())])


def _intervals(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(_INTERVALS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _INTERVALS, strict=True)], schema=_INTERVALS)


def solve_chunk(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows (fp, shard, shards, id, dup, first, bytes) of whole shards. Gives the byte
    intervals of repeats and, for split anchors, the earliest strings (with ``fp``), in batches
    of ``BATCH_ROWS``."""
    rows.sort(key=lambda r: (r[3], r[4], r[5]))
    owner, inside, repeat = repeats([r[6] for r in rows])
    out = []
    at = np.flatnonzero(repeat)
    if len(at):
        new = np.concatenate([[True], (owner[at][1:] != owner[at][:-1]) | (inside[at][1:] != inside[at][:-1] + 1)])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(at)]]) - 1
        for a, b in zip(at[first].tolist(), at[last].tolist(), strict=True):
            r = rows[owner[a]]
            lo = r[5] + int(inside[a])
            out.append((r[3], r[4], lo, r[5] + int(inside[b]) + LENGTH, None, None, None, None))
    for i in np.flatnonzero(~repeat).tolist():
        r = rows[owner[i]]
        if r[2] > 1:
            k = int(inside[i])
            out.append((r[3], r[4], r[5] + k, r[5] + k + LENGTH, r[0], r[1], r[2], r[6][k:k + LENGTH]))
            if len(out) >= BATCH_ROWS:
                yield _intervals(out)
                out = []
    yield _intervals(out)


def solve_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (fp, shard): whole shards are gathered up to a chunk's size. A shard
    over that size is solved in parts, which count as shards of their own."""
    rows: list[tuple] = []
    group: list[tuple] = []
    size = group_size = 0
    key = None

    def flush():
        nonlocal rows, size
        if rows:
            yield from solve_chunk(rows)
        rows, size = [], 0

    def end_group():
        nonlocal group, group_size, size
        if not group:
            return
        if group[0][2] > 1 or group_size > CHUNK_BYTES:
            yield from _alone(group)
        else:
            if size + group_size > CHUNK_BYTES:
                yield from flush()
            rows.extend(group)
            size += group_size
        group, group_size = [], 0

    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (r[0], r[1]) != key:
                yield from end_group()
                key = (r[0], r[1])
            group.append(r)
            group_size += len(r[6])
    yield from end_group()
    yield from flush()


def _alone(group: list[tuple]) -> Iterator[pa.RecordBatch]:
    """One shard: of a split anchor, or so large that it is solved in parts and merged."""
    parts, part, size = [], [], 0
    for r in group:
        if size + len(r[6]) > CHUNK_BYTES:
            parts.append(part)
            part, size = [], 0
        part.append(r)
        size += len(r[6])
    parts.append(part)
    if len(parts) == 1:
        yield from solve_chunk(parts[0])
        return
    merged = Merge()
    for part in parts:
        marked = [(r[0], r[1], max(r[2], 2), *r[3:]) for r in part]
        for batch in solve_chunk(marked):
            found = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            yield _intervals([r for r in found if r[4] is None])
            yield _intervals(merged.add(sorted((r for r in found if r[4] is not None), key=lambda r: r[7])))
    if group[0][2] > 1:
        yield _intervals([(*o[:2], o[2], o[2] + LENGTH, group[0][0], group[0][1], group[0][2], s)
                          for s, o in zip(merged.strings, merged.owners, strict=True)])


class Merge:
    """Sorted strings with their earliest owner; another shard's sorted strings are merged
    in by binary search, from where the one before was found."""

    def __init__(self):
        self.strings: list[bytes] = []
        self.owners: list[tuple] = []

    def add(self, rows: list[tuple]) -> list[tuple]:
        """Add a shard's rows, sorted by string; the intervals that turn out repeats."""
        out, strings, owners, done = [], [], [], 0
        for r in rows:
            at = bisect_left(self.strings, r[7], done)
            strings += self.strings[done:at]
            owners += self.owners[done:at]
            done = at
            own = (r[0], r[1], r[2])
            if strings and strings[-1] == r[7] and (at == 0 or self.strings[at - 1] != r[7]):
                other, slot = owners[-1], len(owners) - 1
            elif at < len(self.strings) and self.strings[at] == r[7]:
                strings.append(r[7])
                owners.append(self.owners[at])
                done = at + 1
                other, slot = owners[-1], len(owners) - 1
            else:
                strings.append(r[7])
                owners.append(own)
                continue
            late = max(other, own)
            owners[slot] = min(other, own)
            if other != own:
                out.append((late[0], late[1], late[2], late[2] + LENGTH, None, None, None, None))
        self.strings = strings + self.strings[done:]
        self.owners = owners + self.owners[done:]
        return out


def dealt_by_string(strings: DataFrame) -> DataFrame:
    """Ranges of (anchor, string), and inside them each shard's strings in order. A string has
    at most one row per shard, so a hot string is not many rows."""
    return (strings.repartitionByRange("fp", "string").sortWithinPartitions("fp", "shard", "string")
                   .select("id", "dup", "lo", "hi", "fp", "shard", "shards", "string"))


def merge_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings sorted by (fp, shard, string): per anchor the shards are merged by binary
    search; every owner of a string but the earliest gives an interval. Held are one range's
    strings of one anchor, each once."""
    fp = shard = None
    merged, run = Merge(), []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (r[4], r[5]) != (fp, shard):
                if run:
                    yield _intervals(merged.add(run))
                run = []
                if r[4] != fp:
                    merged = Merge()
                fp, shard = r[4], r[5]
            run.append(r)
    if run:
        yield _intervals(merged.add(run))


# ------------------------------------------------------------------------- the job

def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, id, dup, text): ``id`` orders documents (null first); ``dup`` numbers the
    different texts of one id (0 where the id has one text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
                    text.alias("text"))
    rows = d.select("id", F.xxhash64("text").alias("rh"))
    many = materialize(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "repeated-ids")
    ranks = (rows.join(many, "id").distinct()
                 .withColumn("dup", F.row_number().over(Window.partitionBy("id").orderBy("rh")) - 1).where("dup > 0"))
    ranks = materialize(ranks.select(F.col("id").alias("__id"), F.col("rh").alias("__rh"), "dup"), "id-ranks")
    return (d.join(ranks, (d["id"] == ranks["__id"]) & (F.xxhash64("text") == ranks["__rh"]), "left")
             .select("doc_id", "id", F.coalesce("dup", F.lit(0)).alias("dup"), "text"))


def usual_runs(rows: DataFrame) -> DataFrame:
    """Runs of anchors with at most ``SHARD_RUNS`` of them, ``copy`` where an equal run
    stands earlier. Runs that stand alone under their anchor go: they repeat nothing."""
    same = Window.partitionBy("fp", "run").orderBy("id", "dup", "first")
    all_runs = Window.partitionBy("fp")
    return (rows.withColumn("at", F.dense_rank().over(same))
                   .withColumn("alone", F.min("run").over(all_runs) == F.max("run").over(all_runs))
                   .where("at > 1 or not alone")
                   .select("id", "dup", "fp", F.lit(0).alias("shard"), "shards", "first", "size", (F.col("at") > 1).alias("copy")))


def hot_runs(rows: DataFrame) -> DataFrame:
    """The same for anchors with more runs, from a written table, without a join or window
    that a hot anchor or run could fill: every run is given as a ``copy``, and the earliest of
    each run, found with map-side combine, once more as one that stands. ``dedup`` drops a
    document's copy where the same run stands."""
    rows = materialize(rows, "hot-runs")
    first = rows.groupBy("fp", "run").agg(F.min(F.struct("id", "dup", "first", "size", "shards")).alias("stands"))
    shard = F.pmod(F.xxhash64("id", "dup", "first"), F.col("shards")).cast("int")
    return (rows.withColumn("copy", F.lit(True)).unionByName(first.select("fp", "run", "stands.*", F.lit(False).alias("copy")))
                .select("id", "dup", "fp", shard.alias("shard"), "shards", "first", "size", "copy"))


def later_copies(d: DataFrame) -> DataFrame:
    """(id, dup) of the documents whose whole text stands in an earlier document."""
    rows = d.select("id", "dup", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")).distinct()
    rows = materialize(rows, "text-hashes")
    first = (rows.groupBy("h1", "h2").agg(F.min(F.struct("id", "dup")).alias("first"), F.count(F.lit(1)).alias("n"))
                 .where("n > 1").drop("n"))
    first = materialize(first, "first-copies")
    return materialize(rows.join(first, ["h1", "h2"]).where(F.col("first") != F.struct("id", "dup")).select("id", "dup"), "later-copies")


def packed(d: DataFrame) -> DataFrame:
    """(id, dup, doc_id, text) with the text's UTF-8 compressed for the shuffle."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=True)
        for batch in batches:
            text = pa.array([squeeze.compress(batch.column(3)[i].as_buffer()) for i in range(batch.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], text], names=["id", "dup", "doc_id", "text"])

    return d.select("id", "dup", "doc_id", "text").mapInArrow(pack, "id long, dup int, doc_id long, text binary")


def listed(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Of a list column: the row of each element, and the elements (a null list has none)."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


def cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, dup, packed text, runs): the bytes of the runs that stand, in batches of
    about ``SEGMENT_BYTES``."""
    schema = pa.schema([("fp", pa.int64()), ("shard", pa.int32()), ("shards", pa.int32()), ("id", pa.int64()),
                        ("dup", pa.int32()), ("first", pa.int64()), ("bytes", pa.binary())])
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        row, runs = listed(batch.column(3))
        stands = pc.invert(runs.field("copy"))
        row, runs = row[stands.to_numpy(zero_copy_only=False)], runs.filter(stands)
        first, size = runs.field("first").to_numpy().tolist(), runs.field("size").to_numpy().tolist()
        bounds = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
        parts, size_now, lo = [], 0, 0
        for i in range(batch.num_rows):
            if bounds[i] < bounds[i + 1]:
                raw = unpack.decompress(batch.column(2)[i].as_buffer())
                parts += [raw[first[j]:first[j] + size[j] + LENGTH - 1] for j in range(bounds[i], bounds[i + 1])]
                size_now += len(raw)
            if parts and (size_now > SEGMENT_BYTES or i + 1 == batch.num_rows):
                at, now = row[lo:lo + len(parts)], runs.slice(lo, len(parts))
                yield pa.RecordBatch.from_arrays(
                    [now.field("fp"), now.field("shard"), now.field("shards"), batch.column(0).take(pa.array(at)),
                     batch.column(1).take(pa.array(at)), now.field("first"), pa.array(parts, pa.binary())], schema=schema)
                lo += len(parts)
                parts, size_now = [], 0


def united(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lo, hi) of the maximal byte spans covered, by row and place."""
    key = (row << 32) + lo
    order = np.argsort(key)
    key, reach = key[order], np.maximum.accumulate(((row << 32) + hi)[order])
    new = np.concatenate([[True], key[1:] > reach[:-1]])[:len(key)]
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(key))[:len(starts)] - 1
    low = (1 << 32) - 1
    return key[starts] >> 32, key[starts] & low, reach[ends] & low


def removed(runs: pa.Array, gone: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans to remove of each row: copies that do not stand in the document itself, and
    the repeats that shards and merges found."""
    row, run = listed(runs)
    first, copy = run.field("first").to_numpy(), run.field("copy").to_numpy(zero_copy_only=False)
    place = (row << 32) + first
    late = copy & ~np.isin(place, place[~copy])
    more, span = listed(gone)
    return united(np.concatenate([row[late], more]), np.concatenate([first[late], span.field("lo").to_numpy()]),
                  np.concatenate([first[late] + run.field("size").to_numpy()[late] + LENGTH - 1, span.field("hi").to_numpy()]))


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, packed text, runs, gone, later): the result of each."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        row, lows, highs = removed(batch.column(2), batch.column(3))
        bounds = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
        lows, highs, later = lows.tolist(), highs.tolist(), batch.column(4).to_pylist()
        out = []
        for i in range(batch.num_rows):
            raw = unpack.decompress(batch.column(1)[i].as_buffer())
            if later[i] and len(raw) >= LENGTH:      # the whole text stands earlier
                out.append((len(raw), len(raw), 1, hashlib.sha256().hexdigest()))
                continue
            kept, done, gone = hashlib.sha256(), 0, 0
            for j in range(bounds[i], bounds[i + 1]):
                kept.update(raw[done:lows[j]])
                done = highs[j]
                gone += done - lows[j]
            kept.update(raw[done:])
            out.append((len(raw), gone, bounds[i + 1] - bounds[i], kept.hexdigest()))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        pa.default_memory_pool().release_unused()


def dedup(docs: DataFrame, shard_runs: int = SHARD_RUNS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    ship_package(docs.sparkSession)
    d = keyed(docs)
    later = later_copies(d)
    # All strings of a later whole copy stand in the first one: none of them is anyone's earliest.
    anchors = file_anchors(d.join(later, ["id", "dup"], "left_anti"))
    common = (anchors.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                     .select("fp", F.ceil(F.col("n") / shard_runs).cast("int").alias("shards")))
    common = materialize(common, "common-anchors")
    most = common.agg(F.max("shards")).first()[0] or 0
    rows = anchors.join(common, "fp")
    if most > 1:
        rows = materialize(rows, "common-runs")
        runs = usual_runs(rows.where("shards = 1")).unionByName(hot_runs(rows.where("shards > 1")))
    else:
        runs = usual_runs(rows)
    # One shuffle of the (packed) texts, and one of the runs, serve both joins below.
    texts = packed(d).repartition("id", "dup")
    wanted = (runs.groupBy("id", "dup").agg(F.collect_set(F.struct("fp", "shard", "shards", "first", "size", "copy")).alias("runs"))
                  .select(F.col("id").alias("id2"), F.col("dup").alias("dup2"), "runs"))

    one = texts.select("id", "dup", "doc_id", "text").join(wanted, (F.col("id") == F.col("id2")) & (F.col("dup") == F.col("dup2")))
    one = one.dropDuplicates(["id", "dup"]).select("id", "dup", "text", "runs")
    segments = one.mapInArrow(cut_segments, "fp long, shard int, shards int, id long, dup int, first long, bytes binary")
    found = segments.repartition("fp", "shard").sortWithinPartitions("fp", "shard").mapInArrow(solve_shards, INTERVALS)
    if most > 1:
        found = materialize(found, "solved-shards")
        strings = dealt_by_string(found.where("fp is not null")).mapInArrow(merge_shards, INTERVALS)
        found = found.where("fp is null").unionByName(strings)
    gone = (found.groupBy("id", "dup").agg(F.collect_list(F.struct("lo", "hi")).alias("gone"))
                 .select(F.col("id").alias("id2"), F.col("dup").alias("dup2"), "gone"))
    gone = gone.withColumnsRenamed({"id2": "id3", "dup2": "dup3"})
    later = later.select(F.col("id").alias("id4"), F.col("dup").alias("dup4"), F.lit(True).alias("later"))
    last = (texts.join(wanted, (F.col("id") == F.col("id2")) & (F.col("dup") == F.col("dup2")), "left")
                 .join(gone, (F.col("id") == F.col("id3")) & (F.col("dup") == F.col("dup3")), "left")
                 .join(later, (F.col("id") == F.col("id4")) & (F.col("dup") == F.col("dup4")), "left").select("doc_id", "text", "runs", "gone", "later"))

    return last.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
