"""Source divergence audit: how far apart the sources of a language use its terms.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. A language keeps
the terms that stand in at least ``MIN_DOCS`` of its documents. A group (a source of a
language, or the language) gives each kept term the smoothed share
``1 + floor(10^9 * (count + 5) / (N + 5 V))``; everything is whole-number arithmetic.

Pairs of sources are priced on hash-consed segment trees over term ids. Kept terms are dealt
to blocks of about ``LEAVES`` ids by hash, and numbered inside a block from frequent to rare.
In a block every group's counts are the leaves of a segment tree; nodes with equal counts
below them are one node, across all groups and places (``Forest``). Two trees are walked
together from the roots; equal pairs of nodes are met as one, with their number, so each is
priced once (``Forest.divergences``). A block's price is a sum over its terms, so the blocks'
prices add up to the whole and no task holds a whole vocabulary.

On Spark: texts become (lang, source, term) counts in the tasks that read them, and are
summed by shuffles on whole keys, so a hot source costs a row per term and task. A block's
groups are dealt in tiles of ``TILE`` sources (every pair of tiles is a task of its own), so
a task holds at most ``2 * TILE`` trees of one block. The result lists each source against
each other one of its language, so its pairs are the size of the answer.

Edge cases: null text, lang and source are ''; a group without kept terms is listed with
counts of 0; with no kept term at all a pair's value is 0; every row is a document, repeated
ones too; a language with one source has no pairs; very long texts are cut into words in one
slice of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ludex.llm import text as X
from ludex.session import materialize, ship_package

MIN_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50
LEAVES = 1024
TILE = 64
SLICE = 3 << 20

_TERM_BYTE = np.zeros(256, dtype=bool)
_TERM_BYTE[65:91] = _TERM_BYTE[97:123] = _TERM_BYTE[128:] = True
HOLE = -1                        # leaf of an id that no term has


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = column.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in X.slices(batch, limit=SLICE):
                low = X.LOWER[data]
                inside = _TERM_BYTE[low]
                edge = np.zeros(len(low) + 1, dtype=bool)
                edge[offsets] = True
                starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]])[:len(low)] | inside & edge[:-1])
                if not len(starts):
                    continue
                letters = np.concatenate([[0], np.cumsum(inside)])
                begins = np.append(letters[starts], letters[-1]).astype(np.int64)
                terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [
                    None, pa.py_buffer(begins.tobytes()), pa.py_buffer(low[inside].tobytes())])
                code, words = _codes(terms)
                row = np.searchsorted(offsets, starts, side="right") - 1
                pairs, times = np.unique(row * len(words) + code, return_counts=True)
                lang, langs = _codes(part.column(0))
                source, sources = _codes(part.column(1))
                group = (lang * len(sources) + source)[pairs // len(words)]
                keys, at = np.unique(group * len(words) + pairs % len(words), return_inverse=True)
                group, code = keys // len(words), keys % len(words)
                yield pa.RecordBatch.from_arrays([
                    langs.take(pa.array(group // len(sources))), sources.take(pa.array(group % len(sources))),
                    words.take(pa.array(code)).cast(pa.binary()).cast(pa.string()),
                    pa.array(np.bincount(at, weights=times).astype(np.int64)), pa.array(np.bincount(at).astype(np.int64))], schema=schema)

    ship_package(docs.sparkSession)
    return (docs.mapInArrow(count, "lang string, source string, term string, n long, docs long")
                .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def share(count: Column, total: Column, terms: Column) -> Column:
    """The smoothed share, exact for any counts."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(20,0)"),
                           (total + SMOOTH * terms).cast("decimal(20,0)")) + 1


def _share(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    whole = total + SMOOTH * terms
    if counts.max(initial=0) < 9_000_000_000 and whole < 1 << 62:         # the products fit in 64 bits
        return 1 + SCALE * (counts + SMOOTH) // whole
    return np.array([1 + SCALE * (int(c) + SMOOTH) // whole for c in counts], dtype=np.int64)


class Forest:
    """Segment trees of several groups over one block's ids, with equal nodes shared.

    ``leaves`` has a row of counts per group, ``HOLE`` where no term has the id. ``levels``
    holds each level's nodes as (left, right) pairs of the level below, the leaves' counts
    are ``values``; ``roots`` has each group's root."""

    def __init__(self, leaves: np.ndarray):
        self.values, ids = np.unique(leaves, return_inverse=True)
        ids = ids.reshape(leaves.shape)
        self.levels: list[np.ndarray] = []
        below = len(self.values)
        while ids.shape[1] > 1:
            nodes, at = np.unique(ids[:, 0::2] * below + ids[:, 1::2], return_inverse=True)
            ids = at.reshape(len(ids), -1)
            self.levels.append(np.column_stack([nodes // below, nodes % below]))
            below = len(nodes)
        self.roots = ids[:, 0]

    def divergences(self, left: np.ndarray, right: np.ndarray, totals: list[int], terms: int) -> np.ndarray:
        """Sum of absolute share differences of each pair (left[i], right[i]) of groups."""
        pair = np.arange(len(left))
        a, b, times = self.roots[left], self.roots[right], np.ones(len(left), dtype=np.int64)
        for nodes in reversed(self.levels):
            pair = np.concatenate([pair, pair])
            a, b = (np.concatenate([nodes[x, 0], nodes[x, 1]]) for x in (a, b))
            pair, a, b, times = _merged(pair, a, b, np.concatenate([times, times]))
        real = self.values[a] != HOLE
        pair, a, b, times = pair[real], a[real], b[real], times[real]
        shares = np.stack([_share(np.maximum(self.values, 0), n, terms) for n in totals])
        price = np.abs(shares[left[pair], a] - shares[right[pair], b]) * times
        out = np.zeros(len(left), dtype=np.int64)
        np.add.at(out, pair, price)
        return out


def _merged(pair: np.ndarray, a: np.ndarray, b: np.ndarray, times: np.ndarray):
    """Equal (pair, a, b) as one, with the sum of their times."""
    width = int(max(a.max(initial=0), b.max(initial=0))) + 1
    keys, at = np.unique((pair * width + a) * width + b, return_inverse=True)
    return keys // (width * width), keys // width % width, keys % width, np.bincount(at, weights=times).astype(np.int64)


def _price_block(key: tuple, block: pa.Table) -> pa.Table:
    """All pairs of the sources of two tiles in one block."""
    low, high = key[2].as_py(), key[3].as_py()
    block = block.sort_by("source")
    size, terms = block.column("size")[0].as_py(), block.column("v")[0].as_py()
    width = 1 << max(size - 1, 0).bit_length()
    leaves = np.full((block.num_rows, width), HOLE, dtype=np.int64)
    leaves[:, :size] = 0
    cells = block.column("cells").combine_chunks()
    rows = np.repeat(np.arange(block.num_rows), pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False))
    flat = cells.flatten()
    leaves[rows, flat.field("id").to_numpy(zero_copy_only=False)] = flat.field("n").to_numpy(zero_copy_only=False)
    tile = block.column("tile").to_numpy()
    left, right = np.triu_indices(block.num_rows, 1)
    own = (np.minimum(tile[left], tile[right]) == low) & (np.maximum(tile[left], tile[right]) == high)
    left, right = left[own], right[own]
    source = block.column("source").combine_chunks()
    value = Forest(leaves).divergences(left, right, block.column("total").to_pylist(), terms) if size else np.zeros(len(left), np.int64)
    return pa.table({"lang": pa.array([key[0].as_py()] * len(left), pa.string()), "source": source.take(pa.array(left)),
                     "item": source.take(pa.array(right)), "value": pa.array(value)})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, leaves: int = LEAVES, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank) as the module says."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = materialize(term_counts(docs), "term-counts")
    kept = materialize(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
                             .where(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    own = materialize(counts.drop("docs").join(kept, ["lang", "term"]), "kept-counts")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = docs.groupBy("lang", "source").count().select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "v", "lang_total")])
    tiles = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    groups = materialize(groups.join(tiles, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), "tiles").cast("int")), "groups")

    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    terms = own.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    by_group = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    terms = terms.withColumn("rank", F.row_number().over(by_group)).where(F.col("rank") <= top)

    # Term ids: a block by hash, inside it a number from frequent to rare.
    blocks = F.greatest(F.ceil(F.col("v") / leaves), F.lit(1)).cast("int")
    ids = kept.join(langs.select("lang", blocks.alias("blocks")), "lang").withColumn("block", F.pmod(F.xxhash64("term"), "blocks").cast("int"))
    place = Window.partitionBy("lang", "block").orderBy(F.col("lang_n").desc(), "term")
    ids = materialize(ids.repartition("lang", "block").select("lang", "term", "block", (F.row_number().over(place) - 1).alias("id")), "term-ids")
    sizes = ids.groupBy("lang", "block").agg(F.count(F.lit(1)).cast("int").alias("size"))
    cells = own.join(ids, ["lang", "term"]).groupBy("lang", "block", "source").agg(F.collect_list(F.struct("id", "n")).alias("cells"))
    rows = (groups.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
                  .join(sizes, ["lang", "block"], "left").join(cells, ["lang", "block", "source"], "left")
                  .withColumn("size", F.coalesce("size", F.lit(0)))
                  .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))))
    rows = rows.select("lang", "block", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"),
                       "source", "tile", "total", "v", "size", "cells")
    priced = rows.groupBy("lang", "block", "low", "high").applyInArrow(_price_block, "lang string, source string, item string, value long")
    pairs = materialize(priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pairs")
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = pairs.withColumn("rank", F.row_number().over(by_group))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(terms.withColumn("part", F.lit("term")).select(columns))


# The same result as plain SQL over all terms of all pairs, for small tables.
AUDIT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(lang_n)::HUGEINT AS lang_total FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(total, 0)::HUGEINT AS total, coalesce(v, 0) AS v, coalesce(lang_total, 0)::HUGEINT AS lang_total
    FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN totals t USING (lang, source) LEFT JOIN langs l ON l.lang = g.lang),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (total + 5 * v) AS p,
    1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v) AS q
    FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM shares x JOIN shares y
        ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
ranked AS (
    SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
    UNION ALL
    SELECT * FROM (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value,
        row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank FROM shares WHERE n > 0 AND p > q) WHERE rank <= 50)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked
"""
