"""Packing documents into training sequences: first-fit decreasing with a tournament tree.

Tokens of a document: the ids of its whole text by the tokenizer file (no special tokens
added, special strings inside a text as the library's default), then ``eos``. A document
is cut only where it must be: full pieces of ``capacity`` tokens, then one remainder.
Each full piece is a sequence of its own; remainders are dealt at random (hash of the
document and its row) into groups of about ``group_docs`` documents, each packed on its
own by first-fit decreasing. "First bin with room" is found in a tournament tree over
the bins' free room: O(log bins) a piece. Groups have a bounded size whatever the input,
so no key is hot and no task sees more than its groups.

Edge cases: a null or empty text is the single token ``eos``; equal documents and ids are
separate pieces (one per row); a null doc_id is kept as null; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ludex.llm.text import LOWER, slices
from ludex.session import materialize, ship_package

CAPACITY = 2048
EOS = 1
GROUP_DOCS = 4096
CACHE_ENTRIES = 300_000
CACHE_CHUNK_CHARS = 64           # bytes of a chunk that is kept
SLICE = 2 << 20                  # text bytes tokenized at once

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long"
PACKED = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[10, 32]] = True
_SMALL = np.zeros(256, dtype=bool)
_SMALL[97:123] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[44, 46]] = True
_SPECIAL = np.zeros(256, dtype=bool)
_SPECIAL[[ord(c) for c in "<>|[]"]] = True     # every special string, and the mark, has one of these


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The chunks of the rows' UTF-8 bytes, in order, and each one's row. A chunk is a run
    without blank or newline; a stop between a small letter and a blank is a chunk of its own
    (it is a pre-token anyway, and there are fewer distinct chunks so). ASCII capitals become
    small, as the normaliser makes them, except where a special string may stand: these are
    matched before."""
    n = len(data)
    solid = ~_BLANK[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    cut = edge[:-1].copy()                             # a chunk begins here, if one is here
    cut[1:] |= ~solid[:-1]
    if n > 2:
        cut[1:-1] |= _STOP[data[1:-1]] & _SMALL[data[:-2]] & _BLANK[data[2:]] & ~edge[1:-2] & ~edge[2:-1]
    starts = np.flatnonzero(solid & cut)
    sizes = np.add.reduceat(solid, starts, dtype=np.int64) if len(starts) else []
    begins = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)
    kept, low = data[solid], LOWER[data[solid]]
    special = np.zeros(len(starts), dtype=bool)
    special[np.searchsorted(begins, np.flatnonzero(_SPECIAL[kept]), side="right") - 1] = True
    if special.any():
        same = np.repeat(special, np.diff(begins))
        low[same] = kept[same]
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [
        None, pa.py_buffer(begins.tobytes()), pa.py_buffer(low.tobytes())])
    return found, np.searchsorted(offsets, starts, side="right") - 1


class ChunkCache:
    """Ids of chunks met before, least lately met last, as two Arrow arrays: some 40 bytes
    an entry, where a dict of ``bytes`` takes 200. It is renewed once a slice."""

    def __init__(self, entries: int):
        self.entries = entries
        self.keys = pa.array([], pa.large_binary())
        self.ids = pa.array([], pa.large_list(pa.uint32()))

    def find(self, wanted: pa.Array) -> pa.Array:
        """Place of each wanted chunk in the cache, null where it has none."""
        return pc.index_in(wanted, value_set=self.keys)

    def renew(self, met: pa.Array, ids: pa.Array, places: pa.Array) -> None:
        """Put the chunks just met (with ``find``'s places) before all others, and let go
        what is over the bound."""
        short = pc.less_equal(pc.binary_length(met), CACHE_CHUNK_CHARS)
        met, ids = met.filter(short), ids.filter(short)
        rest = np.ones(len(self.keys), dtype=bool)
        rest[places.drop_null().to_numpy()] = False
        rest = np.flatnonzero(rest)[:max(self.entries - len(met), 0)]
        self.keys = pa.concat_arrays([met[:self.entries], self.keys.take(pa.array(rest))])
        self.ids = pa.concat_arrays([ids[:self.entries], self.ids.take(pa.array(rest))])


def _lists(values: np.ndarray | list, sizes: np.ndarray | list) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.asarray(values, dtype=np.uint32)))


class ChunkTokenizer:
    """Ids of texts through a cache of space-separated chunks: a slice of rows is cut into
    chunks at once, only its distinct chunks are looked up, and their ids are gathered. Exact for tokenizers whose pre-tokenizer drops white space: no token, and no
    step of the normaliser, reaches over a blank, so a text's ids are its chunks' ids in
    order. Chunks the cache lacks go to the library in one text, with ``MARK`` (a token of
    its own) between them; chunks that contain the mark or a special string go alone."""

    MARK = "|"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # one core a task
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.mark = self._encode(self.MARK)
        if len(self.mark) != 1:
            raise ValueError(f"{self.MARK!r} is not one token of {path}")
        alone = [self.MARK, *(t.content for t in self.tok.get_added_tokens_decoder().values())]
        if not all(any(_SPECIAL[b] for b in a.encode()) for a in alone):
            raise ValueError(f"a special string of {path} could arise from small letters")
        self.alone = re.compile(b"|".join(re.escape(a.encode()) for a in alone))
        self.cache = ChunkCache(CACHE_ENTRIES)

    def _encode(self, text: str) -> np.ndarray:
        return np.asarray(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _lookup(self, missing: pa.Array) -> pa.Array:
        """The ids of each chunk, by the library."""
        lists, places = [_lists([], [])], []
        for lo in range(0, len(missing), 5_000):
            part = missing[lo:lo + 5_000].to_pylist()
            alone = [i for i, c in enumerate(part) if self.alone.search(c)]
            joined = np.setdiff1d(np.arange(len(part)), alone)
            if len(joined):
                ids = self._encode(f" {self.MARK} ".join([part[i].decode() for i in joined.tolist()]))
                marks = np.flatnonzero(ids == self.mark[0])
                if len(marks) != len(joined) - 1:
                    raise ValueError("a chunk's ids hold the mark")
                lists.append(_lists(ids[ids != self.mark[0]], np.diff(marks, prepend=-1, append=len(ids)) - 1))
            each = [self._encode(part[i].decode()) for i in alone]
            lists.append(_lists(np.concatenate(each) if each else [], [len(x) for x in each]))
            places += [lo + joined, lo + np.asarray(alone, dtype=np.int64)]
        return pa.concat_arrays(lists).take(pa.array(np.argsort(np.concatenate(places)) if places else [], pa.int64()))

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in one array, and where each row's ids begin (one more at the end)."""
        found, row = chunks(data, offsets)
        coded = found.dictionary_encode()
        places = self.cache.find(coded.dictionary)
        missing = pc.is_null(places)
        new = self._lookup(coded.dictionary.filter(missing))
        order = np.cumsum(missing.to_numpy(zero_copy_only=False)) - 1 + len(self.cache.ids)
        lists = pa.concat_arrays([self.cache.ids, new]).take(pc.coalesce(places.cast(pa.int64()), pa.array(order)))
        self.cache.renew(coded.dictionary, lists, places)
        taken = lists.take(coded.indices)
        first = np.searchsorted(row, np.arange(len(offsets)))            # chunks before each row
        at = taken.offsets.to_numpy()
        return taken.values.to_numpy(), at[first] if len(at) else np.zeros(len(offsets), np.int64)

    def ids(self, text: str) -> bytes:
        """Ids of one text as little-endian 32-bit bytes."""
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        return self.rows(raw, np.array([0, len(raw)]))[0].tobytes()


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def chunk_tokenizer(path: str) -> ChunkTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def cut_pieces(docs: DataFrame, path: str, capacity: int, eos: int) -> DataFrame:
    """One row per piece: start, length, crc32 of its ids; ``deal`` is the row's random
    number. The row's place in the input is part of it, so equal rows and rows without id
    spread too; it is drawn once, in the task that writes the pieces."""
    ship_package(docs.sparkSession)
    tail = np.asarray([eos], dtype="<u4").tobytes()
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = chunk_tokenizer(path)
        for batch in batches:
            for part, data, offsets in slices(batch, limit=SLICE):
                flat, at = tok.rows(data, offsets)
                cols: list[list] = [[] for _ in range(6)]
                for doc, deal, lo, hi in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    n = hi - lo + 1                                       # with eos
                    for start in range(0, n, capacity):
                        size = min(capacity, n - start)
                        crc = zlib.crc32(flat[lo + start:min(lo + start + size, hi)])
                        if start + size == n:
                            crc = zlib.crc32(tail, crc)
                        for col, v in zip(cols, (doc, start, size, crc, n, deal), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.xxhash64("doc_id", F.length("text"), F.monotonically_increasing_id()).alias("deal"))
    return rows.mapInArrow(cut, PIECES)


class FirstFit:
    """Bins of equal capacity under a tournament tree: every inner node holds the largest
    free room below it, so the leftmost bin with room for ``size`` is found by descending."""

    def __init__(self, bins: int, capacity: int):
        self.width = 1
        while self.width < max(bins, 1):
            self.width *= 2
        self.room = [capacity] * (2 * self.width)
        self.capacity = capacity

    def place(self, size: int) -> tuple[int, int]:
        """Bin for a piece and the piece's offset in it."""
        room, node = self.room, 1
        while node < self.width:
            node *= 2
            if room[node] < size:
                node += 1
        offset = self.capacity - room[node]
        room[node] -= size
        place = node - self.width
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return place, offset


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) per piece; every length is between 1 and ``capacity``. Pieces go
    longest first (ties in input order), each to the first bin with room."""
    tree = FirstFit(len(lengths), capacity)
    bins = np.zeros(len(lengths), dtype=np.int64)
    offsets = np.zeros(len(lengths), dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        bins[i], offsets[i] = tree.place(int(lengths[i]))
    return bins, offsets


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, eos: int = EOS,
         group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pieces of all documents with their sequence and offset. ``sequence_id`` is the
    group's number times 2**32 plus the bin's number in the group."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    pieces = materialize(cut_pieces(docs, path, capacity, eos), "pieces")
    n_groups = max(1, -(-pieces.where(F.col("start") == 0).count() // group_docs))

    def pack_group(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"],
                                  ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        out = group.drop(columns=["grp", "deal"])
        out["sequence_id"] = (int(key[0]) << 32) + bins
        out["offset"] = offsets
        return out

    # Full pieces never share a sequence: they spread by (document, start), so one very
    # long document is not one group's work.
    full = F.col("length") == capacity
    grp = F.pmod(F.when(full, F.xxhash64("deal", "start")).otherwise(F.xxhash64("deal")), F.lit(n_groups))
    return (pieces.withColumn("grp", grp).groupBy("grp")
                  .applyInPandas(pack_group, PACKED))
