"""Quality classifier: a factorisation machine over hashed words, structure statistics and
metadata of a text.

Features of a document: its lower-cased words hashed into ``N_BUCKETS`` (term counts of
the whole text, scaled to unit length) and ``STATS``, each cut into thermometer bits so
that pairwise interactions of word and structure features are products of 0/1 values.
Pair interactions are low rank and scored in linear time:
``sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``.

Training uses at most ``MAX_TRAIN_ROWS`` labelled documents (smallest hashes of doc_id;
the documented bound), in one task of bounded size; the model is a small array sent with
the scoring function. Scoring is one narrow pass over all documents. Labels, lang, source
and doc_id are never inputs of a score.

Edge cases: null or empty text has only its statistics as features and is scored;
documents without a label, or with a null one, don't train; conflicting labels of one id
count as 0; with no labelled rows every score is 1.0; a null doc_id is scored and counts as
not held out; equal rows get equal scores; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ludex.llm.text import LOWER, WHITESPACE, mix, prefix_hash, slices, span_hash, word_spans
from ludex.session import ship_package

THRESHOLD = 0.3
MAX_TRAIN_ROWS = 6000
N_BUCKETS = 1 << 13
RANK = 8
EPOCHS = 12
LEARNING_RATE = 0.05
L2 = 2e-5
BATCH = 64
FOLDS = 5

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>!@^~_=+{}[]\\"]] = True
_BAR = np.zeros(256, dtype=bool)
_BAR[ord("|")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_ALPHA = _UPPER.copy()
_ALPHA[97:123] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".,;:?"]] = True
_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[10] = True

# Statistic: cut points of its thermometer bits.
STATS: dict[str, tuple[float, ...]] = {
    "words": (0.5, 5, 20, 50, 100, 300, 1000, 5000),
    "symbols_per_word": (0.01, 0.05, 0.1, 0.2, 0.4, 0.8, 1.5),
    "bars_per_word": (0.02, 0.1, 0.2, 0.4),
    "upper_share": (0.02, 0.05, 0.1, 0.2, 0.4, 0.7),
    "digit_share": (0.005, 0.02, 0.05, 0.2),
    "distinct_share": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8),
    "repeat_share": (0.02, 0.05, 0.1, 0.2, 0.4, 0.7),
    "word_bytes": (3, 4, 5, 6, 7, 8, 10, 14),
    "stops_per_word": (0.01, 0.05, 0.1, 0.2, 0.5),
    "words_per_line": (2, 5, 10, 20, 50, 150),
    "bytes": (10, 100, 500, 2000, 10000, 50000),     # metadata: the text's stored size
}
STAT_BITS = sum(map(len, STATS.values()))
N_FEATURES = N_BUCKETS + STAT_BITS


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (row starts, feature, value) of the texts in one slice."""
    n_rows = len(offsets) - 1
    low = LOWER[data]
    starts, ends, rows = word_spans(low, offsets)
    hashes = span_hash(prefix_hash(low), starts, ends)
    buckets = (hashes % np.uint64(N_BUCKETS)).astype(np.int64)
    keys, counts = np.unique(rows * N_BUCKETS + buckets, return_counts=True)
    key_rows = keys // N_BUCKETS
    norm = np.sqrt(np.bincount(key_rows, weights=counts.astype(float) ** 2, minlength=n_rows))
    values = counts / norm[key_rows]

    def share(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask[data])])
        return (c[offsets[1:]] - c[offsets[:-1]]).astype(float)

    n_words = np.bincount(rows, minlength=n_rows).astype(float)
    same = (rows[1:] == rows[:-1]) & (hashes[1:] == hashes[:-1]) if len(rows) > 1 else np.zeros(0, bool)
    distinct = np.unique(mix(hashes ^ rows.astype(np.uint64)), return_index=True)[1] if len(rows) else np.zeros(0, int)
    w = np.maximum(n_words, 1)
    letters = np.maximum(share(_ALPHA), 1)
    solid = np.maximum(share(~WHITESPACE), 1)
    stats = np.column_stack([
        n_words, share(_SYMBOL) / w, share(_BAR) / w, share(_UPPER) / letters, share(_DIGIT) / solid,
        np.bincount(rows[distinct], minlength=n_rows) / w,
        np.bincount(rows[1:][same], minlength=n_rows) / w,
        np.bincount(rows, weights=(ends - starts).astype(float), minlength=n_rows) / w,
        share(_STOP) / w, w / (share(_NEWLINE) + 1), np.diff(offsets).astype(float)])
    cols = [stats[:, [j]] >= np.array(cuts) for j, cuts in enumerate(STATS.values())]
    bits = np.concatenate(cols, axis=1)
    bit_rows, bit_cols = np.nonzero(bits)
    scale = 1 / np.sqrt(len(STATS))
    all_rows = np.concatenate([key_rows, bit_rows])
    order = np.argsort(all_rows, kind="stable")
    feature = np.concatenate([keys % N_BUCKETS, N_BUCKETS + bit_cols])[order]
    value = np.concatenate([values, np.full(len(bit_rows), scale)])[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(all_rows, minlength=n_rows))])
    return first, feature, value


def _sum_by_row(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    c = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
    return c[first[1:]] - c[first[:-1]]


class FactorisationMachine:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w0 = 0.0
        self.w = np.zeros(N_FEATURES)
        self.v = rng.normal(0, 0.01, (N_FEATURES, RANK))

    def raw(self, first, feature, value):
        """Scores before the logistic, and the factor sums of each row."""
        vx = self.v[feature] * value[:, None]
        sums = _sum_by_row(vx, first)
        squares = _sum_by_row((vx ** 2).sum(axis=1), first)
        return self.w0 + _sum_by_row(self.w[feature] * value, first) + 0.5 * ((sums ** 2).sum(axis=1) - squares), sums

    def score(self, first, feature, value) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(first, feature, value)[0], -35, 35)))

    def fit(self, first, feature, value, label, seed: int = 11) -> None:
        """Logistic loss, mini-batches, per-coordinate adaptive steps."""
        rng = np.random.default_rng(seed)
        g0, gw, gv = 1e-6, np.full(N_FEATURES, 1e-6), np.full((N_FEATURES, RANK), 1e-6)
        p = (label.sum() + 1) / (len(label) + 2)
        self.w0 = float(np.log(p / (1 - p)))
        for _ in range(EPOCHS):
            order = rng.permutation(len(label))
            for lo in range(0, len(order), BATCH):
                rows = order[lo:lo + BATCH]
                size = first[rows + 1] - first[rows]
                at = np.repeat(first[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                f, x = feature[at], value[at]
                own = np.concatenate([[0], np.cumsum(size)])
                raw, sums = self.raw(own, f, x)
                err = (1 / (1 + np.exp(-np.clip(raw, -35, 35))) - label[rows]) / len(rows)
                e = np.repeat(err, size)
                used, slot = np.unique(f, return_inverse=True)
                dw = np.bincount(slot, weights=e * x) + L2 * self.w[used]
                grad = e[:, None] * x[:, None] * (np.repeat(sums, size, axis=0) - self.v[f] * x[:, None])
                dv = np.column_stack([np.bincount(slot, weights=grad[:, k]) for k in range(RANK)]) + L2 * self.v[used]
                d0 = err.sum()
                g0 += d0 ** 2
                gw[used] += dw ** 2
                gv[used] += dv ** 2
                self.w0 -= LEARNING_RATE * d0 / np.sqrt(g0)
                self.w[used] -= LEARNING_RATE * dw / np.sqrt(gw[used])
                self.v[used] -= LEARNING_RATE * dv / np.sqrt(gv[used])

    def dump(self) -> bytes:
        return np.concatenate([[self.w0], self.w, self.v.ravel()]).astype("<f8").tobytes()

    @classmethod
    def load(cls, raw: bytes) -> FactorisationMachine:
        a = np.frombuffer(raw, dtype="<f8")
        fm = cls.__new__(cls)
        fm.w0, fm.w, fm.v = float(a[0]), a[1:1 + N_FEATURES], a[1 + N_FEATURES:].reshape(N_FEATURES, RANK)
        return fm


def held_out(doc_id: Column) -> Column:
    """The fold of a document: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> bytes | None:
    """Fit on at most ``max_rows`` labelled documents outside the held-out fold."""
    ship_package(docs.sparkSession)
    chosen = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
                    .groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("__label"))
                    .orderBy(F.xxhash64("__id"), "__id").limit(max_rows))
    # At most max_rows rows of two numbers: a proven bound for the broadcast.
    rows = (docs.select(F.col("doc_id").alias("__id"), F.col("text").cast("string").alias("text"))
                .join(F.broadcast(chosen), "__id").select("text", F.col("__label").cast("double").alias("label")))
    sparse = pa.schema([("feature", pa.list_(pa.int32())), ("value", pa.list_(pa.float32())), ("label", pa.float64())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch):
                first, feature, value = features(data, offsets)
                at = pa.array(first.astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(at, pa.array(feature.astype(np.int32))),
                    pa.ListArray.from_arrays(at, pa.array(value.astype(np.float32))), part.column(1)], schema=sparse)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=sparse)
        if not table.num_rows:
            return
        feature, value = (table.column(c).combine_chunks() for c in ("feature", "value"))
        label = table.column("label").to_numpy()
        size = feature.value_lengths().to_numpy()
        first = np.concatenate([[0], np.cumsum(size)])
        f, x = feature.flatten().to_numpy(), value.flatten().to_numpy().astype(float)
        order = np.lexsort((_sum_by_row(x * (f + 1.0), first), size, label))   # any arrival order gives one model
        at = np.repeat(first[order] - np.concatenate([[0], np.cumsum(size[order])[:-1]]), size[order]) + np.arange(size.sum())
        fm = FactorisationMachine()
        fm.fit(np.concatenate([[0], np.cumsum(size[order])]), f[at], x[at], label[order])
        yield pa.RecordBatch.from_arrays([pa.array([fm.dump()], pa.binary())], names=["model"])

    small = rows.mapInArrow(extract, "feature array<int>, value array<float>, label double")
    found = small.repartition(1).mapInArrow(fit, "model binary").first()
    return bytes(found[0]) if found else None


def _scores(model: bytes | None, batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Row slices of a batch, bounded by their text bytes, with their scores (1.0 without a
    model)."""
    fm = FactorisationMachine.load(model) if model else None
    for part, data, offsets in slices(batch, text):
        yield part, fm.score(*features(data, offsets)) if fm else np.ones(part.num_rows)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
                    max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    ship_package(docs.sparkSession)
    model = train(docs, labels, max_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in _scores(model, batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found)], names=["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(score, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
              max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """The documents that the classifier accepts, with all their columns. Rows pass through
    the scoring function in slices bounded by bytes, so no batch of whole rows waits for its
    scores."""
    ship_package(docs.sparkSession)
    model = train(docs, labels, max_rows)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in _scores(model, batch, "text"):
                yield part.filter(pa.array(found >= threshold))

    return docs.mapInArrow(keep, docs.schema)
