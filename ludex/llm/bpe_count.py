"""Token counts of whole texts by byte-pair merging, without emitting identifiers.

A text is split at the tokenizer's special strings (one token each, the library's
default), each part into pre-tokens by the byte-level pattern, and every pre-token's
bytes are merged on a linked list: a heap holds the adjacent pairs by merge rank (ties:
leftmost), the lowest is popped and, if both its symbols are still there, merged. The
count is the number of initial symbols minus the number of merges.

Each Python worker keeps counts of pre-tokens it has met in a cache of bounded size.
Edge cases: null or empty text counts 0 bytes and 0 tokens; equal rows give equal rows;
null doc_id stays null; no other column is read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ludex.llm.cache import TwoGenerationCache
from ludex.session import ship_package

LIMIT = 1024
CACHE_ENTRIES = 600_000          # per generation
CACHE_BYTES = 64

# Fixed value: the pre-tokenization pattern of byte-level BPE vocabularies of this kind.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where visible, else the next code
    points from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        if b in visible:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class BpeCounter:
    """Counts tokens under a byte-level BPE file (``model.merges`` and ``added_tokens``)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = {c: i for i, c in enumerate(byte_alphabet())}
        self.rank: dict[int, int] = {}      # left symbol << 32 | right symbol -> merge rank
        self.merged: list[int] = []         # merge rank -> merged symbol
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merged.append(symbols.setdefault(left + right, len(symbols)))
            self.rank.setdefault(symbols[left] << 32 | symbols[right], rank)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = regex.compile(BYTE_LEVEL_PATTERN)
        self.cache = TwoGenerationCache(CACHE_ENTRIES)

    def merge_count(self, data: bytes) -> int:
        """Initial symbols minus merges of one pre-token. Heap entries are rank and left
        position in one integer; an entry is stale unless the pair now at that position
        still has that rank."""
        n = len(data)
        get, merged = self.rank.get, self.merged
        heap = [r << 32 | i for i, (a, b) in enumerate(zip(data, data[1:], strict=False))
                if (r := get(a << 32 | b)) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        symbol = [*data, -1]                               # -1 ends the list
        before, after = list(range(-1, n)), list(range(1, n + 2))
        left = n
        while heap:
            entry = pop(heap)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            a = symbol[i]
            if a < 0:
                continue                                   # merged into its left neighbour
            j = after[i]
            b = symbol[j]
            if b < 0 or get(a << 32 | b) != rank:
                continue
            symbol[i], symbol[j] = merged[rank], -1
            k = after[i] = after[j]
            before[k] = i
            left -= 1
            if (c := symbol[k]) >= 0 and (r := get(symbol[i] << 32 | c)) is not None:
                push(heap, r << 32 | i)
            if (h := before[i]) >= 0 and (r := get(symbol[h] << 32 | symbol[i])) is not None:
                push(heap, r << 32 | h)
        return left

    def _part(self, text: str) -> int:
        cache = self.cache.young
        words = self.split.findall(text)
        try:
            return sum([cache[w] for w in words])
        except KeyError:
            pass
        long = {}
        for w in self.cache.missing(words):
            data = w.encode("utf-8")
            (cache if len(data) <= CACHE_BYTES else long)[w] = self.merge_count(data)
        total = sum([long[w] if w in long else cache[w] for w in words])
        self.cache.renew()
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self._part(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self._part(p) for p in parts if p)


_COUNTERS: dict[str, BpeCounter] = {}


def bpe_counter(path: str) -> BpeCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = BpeCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document; a narrow pass."""
    ship_package(docs.sparkSession)
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = bpe_counter(path)
        for batch in batches:
            texts = batch.column(1)
            counts = [counter.count(texts[i].as_py() or "") for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    return (rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
                .withColumn("over_limit", F.col("n_tokens") > F.lit(limit)))
