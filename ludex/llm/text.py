"""Vectorised helpers over Arrow text columns, used inside Spark tasks.

Every helper takes whole texts; a null text counts as empty. Batches are cut into slices
of at most ``SLICE_BYTES`` of text (a longer document is a slice of its own), which bounds
the memory of a task whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_U = np.uint64
# Fixed odd multipliers of the 64-bit hashes below.
_RADIX = 0x9E3779B97F4A7C15
_RADIX_INVERSE = pow(_RADIX, -1, 1 << 64)
_MIX_A, _MIX_B = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)

WHITESPACE = np.zeros(256, dtype=bool)
WHITESPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x *= _MIX_A
    x ^= x >> _U(27)
    x *= _MIX_B
    x ^= x >> _U(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64))


class _Powers:
    """Powers of the radix and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 1)
            for name, base in (("up", _RADIX), ("down", _RADIX_INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


POWERS = _Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash; ``span_hash`` reads any span from them."""
    up, _ = POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODE[data] * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span [start, end), equal for equal bytes wherever they lie."""
    _, down = POWERS.upto(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def window_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """``span_hash`` of every window of ``width`` bytes, in order."""
    _, down = POWERS.upto(len(prefix))
    return mix((prefix[width:] - prefix[:-width]) * down[:len(prefix) - width])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of a batch with at most ``limit`` text bytes (at least one row each)."""
    if batch.num_rows == 0:
        return
    data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), batch.num_rows)
        yield batch.slice(lo, hi - lo), data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word ``[^\\x20\\x09-\\x0D]+``; words never cross rows."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    solid = np.zeros(n + 2, dtype=bool)
    solid[1:-1] = ~WHITESPACE[data]
    border = np.zeros(n + 1, dtype=bool)
    border[offsets] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | border[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | border[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def shingles(word_hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all ``width``-word shingles; a row with fewer words (one at
    least) has its whole word sequence as its only shingle."""
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(counts)])
    salted = [mix(word_hashes + _U((j + 1) * int(_MIX_A) % (1 << 64))) * _U(2 * j + 3) for j in range(width)]
    total = len(word_hashes)
    parts_h, parts_r = [], []
    if total >= width:
        acc = np.zeros(total - width + 1, dtype=np.uint64)
        for j in range(width):
            acc += salted[j][j:total - width + 1 + j]
        whole = rows[:total - width + 1] == rows[width - 1:]
        parts_h.append(mix(acc[whole]))
        parts_r.append(rows[:total - width + 1][whole])
    for k in range(1, width):
        short = np.flatnonzero(counts == k)
        if len(short):
            acc = np.full(len(short), k, dtype=np.uint64)
            for j in range(k):
                acc += salted[j][first[short] + j]
            parts_h.append(mix(mix(acc) + _U(k)))
            parts_r.append(short)
    if not parts_h:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(parts_h), np.concatenate(parts_r)
