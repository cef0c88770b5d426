"""Benchmark decontamination by templates, as DataFrame expressions only.

A text's words are canonicalised: numbers, quantities, units and names become typed
placeholders (``<num>``, ``<unit>``, ``<name>``) and other words are lower-cased without
outer punctuation. Every window of ``WIDTH`` canonical words of every document is
hash-joined to the windows of the benchmark's items (an item with fewer words is one window
of its own length). Windows of a document on one diagonal of an item (document position
minus item position) must fill the item's slots consistently: one item value, one document
value. An item whose windows are covered by consistent ones to at least ``MIN_COVERAGE`` is
leaked, verbatim or with other parameters.

Windows with fewer than ``MIN_LITERAL`` of their words literal (five of eight, in
proportion) match anything and are left out of the item. An item without any other window, or
of fewer than ``MIN_WORDS`` words, is matched whole instead: all its canonical words, signs
that stand alone included, against as many words of a document. Verbatim it may stand anywhere.
With other values (consistent ones) it counts anywhere if ``SURE_LITERALS`` of its words are
literal, and with ``BOUND_LITERALS`` of them where it is a sentence or line of its own, or
several. Items of two or three words count only verbatim and as a sentence or line of their
own; an item of one word is no template and matches nothing (``unmatched_items`` lists these).

Scale: only the distinct window hashes of the benchmark meet the hashes of the documents'
windows, from a written table whose size decides between broadcast and shuffle; slots are
read only from documents with a hit. A window repeated in many documents is one benchmark row, so no pairs arise.

Edge cases: null or empty texts hold no window; rows that repeat a doc_id and text are
reported once, rows that repeat only a doc_id each for its own text; a null doc_id is
reported as null; a null item_id is an item of its own; repeated items are reported once; very
long texts are taken whole; empty tables give no leak. Other columns are not read by the
report; ``decontaminate`` returns them as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ludex.session import materialize

WIDTH = 8
MIN_LITERAL = 5
MIN_WORDS = 4
MIN_COVERAGE = 0.5
SURE_LITERALS = 4
BOUND_LITERALS = 2

SPACE = "[\\x20\\x09-\\x0D]+"
# What counts as a number, a unit, a name, and the end of a sentence.
EDGES = "^[^\\p{L}\\p{N}+\\-$€£%°]+|[^\\p{L}\\p{N}%°$€£]+$"
NUMBER = ("^[+\\-$€£]*[0-9][0-9.,:/]*(st|nd|rd|th|%|°|°c|°f|km|cm|mm|kg|mg|ml|kmh|mph|k|m|g|s|h|x|usd|eur)?$|"
          "^(two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|twenty|thirty|forty|fifty|sixty|"
          "seventy|eighty|ninety|hundred|thousand|million|billion)$")
UNIT = ("^(km|cm|mm|kg|mg|ml|km/h|mph|kmh|%|\\$|€|£|usd|eur|dollars?|euros?|pounds?|cents?|meters?|metres?|kilometers?|"
        "kilometres?|miles?|feet|foot|inch|inches|yards?|grams?|kilograms?|liters?|litres?|gallons?|seconds?|minutes?|"
        "hours?|days?|weeks?|months?|years?|degrees?|percent)$")
NAME = "^\\p{Lu}\\p{Ll}+(?:[-'’]\\p{L}+)*$"
SENTENCE_END = "[.!?:][\"'”’)\\]]*$"


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


# A word of small letters only is itself, unless listed: most words need no more than this.
PLAIN = "^[a-zß-öø-ÿ]+$"
NUMBER_WORDS = ("two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty "
                "seventy eighty ninety hundred thousand million billion").split()
UNIT_WORDS = ("km cm mm kg mg ml mph kmh usd eur dollar dollars euro euros pound pounds cent cents meter meters metre "
              "metres kilometer kilometers kilometre kilometres mile miles feet foot inch inches yard yards gram grams "
              "kilogram kilograms liter liters litre litres gallon gallons second seconds minute minutes hour hours day "
              "days week weeks month months year years degree degrees percent").split()


def canonical(text: Column, slots: bool = True) -> Column:
    """array<struct<t string, v string>>: canonical word, and the slot's value where the
    word is a placeholder; without ``slots`` array<string> of the canonical words."""
    def plain(w: Column) -> Column:
        kind = F.when(w.isin(NUMBER_WORDS), F.lit("<num>")).when(w.isin(UNIT_WORDS), F.lit("<unit>"))
        if not slots:
            return F.coalesce(kind, w)
        return let(kind, lambda k: F.struct(F.coalesce(k, w).alias("t"), F.when(k.isNotNull(), w).alias("v")))

    def word(raw: Column, opens: Column) -> Column:
        rest = other(raw, opens)
        return F.when(raw.rlike(PLAIN), plain(raw)).otherwise(rest if slots else rest["t"])

    def other(raw: Column, opens: Column) -> Column:
        return let(F.regexp_replace(raw, EDGES, ""), lambda w: let(F.lower(w), lambda x: F.when(
            x.rlike(NUMBER), F.struct(F.lit("<num>").alias("t"), x.alias("v"))).when(
            x.rlike(UNIT), F.struct(F.lit("<unit>").alias("t"), x.alias("v"))).when(
            w.rlike(NAME) & ~opens, F.struct(F.lit("<name>").alias("t"), x.alias("v"))).otherwise(
            F.struct(x.alias("t"), F.lit(None).cast("string").alias("v")))))

    raw = F.filter(F.split(text, SPACE), lambda w: w != F.lit(""))
    words = let(raw, lambda r: F.transform(r, lambda w, i: word(w, F.when(i == 0, F.lit(True)).otherwise(
        F.element_at(r, F.greatest(i, F.lit(1))).rlike(SENTENCE_END)))))
    return F.filter(words, lambda w: (w["t"] if slots else w) != F.lit(""))


def window_hashes(words: Column, width: int) -> Column:
    """Hashes of all windows of canonical words, by position."""
    def over(h: Column) -> Column:
        starts = F.when(F.size(h) >= width, F.sequence(F.lit(1), F.size(h) - (width - 1))).otherwise(
            F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.lit(width), *[F.element_at(h, i + k) for k in range(width)]))

    return let(F.transform(words, lambda w: F.xxhash64(w)), over)


def window(words: Column, start: Column, width: int) -> Column:
    """struct<h long, slots array<string>> of the words from 0-based ``start``."""
    return let(F.slice(words, start + 1, width), lambda s: F.struct(
        F.xxhash64(F.lit(width), *[F.xxhash64(F.element_at(s, k + 1)["t"]) for k in range(width)]).alias("h"),
        F.transform(F.filter(s, lambda w: w["v"].isNotNull()), lambda w: w["v"]).alias("slots")))


def windows(words: Column, width: int) -> Column:
    starts = F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, lambda i: window(words, i, width))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, i, width, h, slots, n_windows) of the items' usable windows."""
    words = benchmark.select("item_id", canonical(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w")).where(
        F.size("w") >= MIN_WORDS)
    def item_part(width: int) -> DataFrame:
        fits = F.size("w") >= WIDTH if width == WIDTH else F.size("w") == width
        at = F.transform(F.sequence(F.lit(0), F.size("w") - width), lambda i: F.struct(
            window(F.col("w"), i, width).alias("x"),
            F.size(F.filter(F.slice("w", i + 1, width), lambda t: t["v"].isNull())).alias("literal")))
        return (words.where(fits).select("item_id", F.posexplode(at).alias("i", "y"))
                     .where(F.col("y.literal") * WIDTH >= MIN_LITERAL * width)
                     .select("item_id", "i", F.lit(width).alias("width"), "y.x.h", "y.x.slots"))

    parts = [item_part(width) for width in range(MIN_WORDS, WIDTH + 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.distinct()
    total = out.select("item_id", "i").distinct().groupBy("item_id").agg(F.count(F.lit(1)).alias("n_windows"))
    total = total.withColumnRenamed("item_id", "__item")
    return out.join(total, F.col("item_id").eqNullSafe(F.col("__item"))).drop("__item")


def leaks(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, __row, item_id, n_matched, n_windows, verbatim) of every leaked item."""
    items = materialize(item_windows(benchmark), "item-windows")
    hashes = materialize(items.select("h").distinct(), "item-hashes")
    widths = [r[0] for r in items.select("width").distinct().collect()]          # at most WIDTH values
    if not widths:
        widths = [WIDTH]
    d = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("__row"), F.col("text").cast("string").alias("text"))
    # First over all documents: who holds a window of an item at all (hashes only).
    any_hash = let(canonical(F.col("text"), slots=False), lambda w: F.concat(*[window_hashes(w, n) for n in sorted(widths)]))
    found = (d.select("doc_id", "__row", F.explode(any_hash).alias("h")).join(hashes, "h", "left_semi")
              .select(F.col("doc_id").alias("__id"), F.col("__row").alias("__hit")).distinct())
    found = materialize(found, "documents-with-windows")
    d = d.join(found, (d["__row"] == found["__hit"]) & d["doc_id"].eqNullSafe(found["__id"]), "left_semi")
    # Then, for those documents, the windows with their slots.
    slotted = let(canonical(F.col("text")), lambda w: F.concat(*[
        F.transform(windows(w, n), lambda x, j: F.struct(x["h"].alias("h"), x["slots"].alias("slots"), j.alias("j")))
        for n in sorted(widths)]))
    rows = d.select("doc_id", "__row", F.explode(slotted).alias("x")).select("doc_id", "__row", "x.h", "x.slots", "x.j")
    hits = rows.join(hashes, "h", "left_semi")
    pairs = (hits.withColumnRenamed("slots", "doc_slots").join(items, "h")
                 .select("doc_id", "__row", "item_id", "n_windows", "i", (F.col("j") - F.col("i")).alias("diagonal"),
                         F.arrays_zip(F.col("slots").alias("b"), F.col("doc_slots").alias("d")).alias("z")))
    runs = (pairs.groupBy("doc_id", "__row", "item_id", "n_windows", "diagonal")
                 .agg(F.collect_set("i").alias("at"), F.array_distinct(F.flatten(F.collect_set("z"))).alias("z")))
    consistent = F.size("z") == F.size(F.array_distinct(F.transform("z", lambda p: p["b"])))
    same = F.size(F.filter("z", lambda p: p["b"] != p["d"])) == 0
    out = (runs.where(consistent).withColumn("same", same)
               .groupBy("doc_id", "__row", "item_id", "n_windows")
               .agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_matched"),
                    F.bool_and("same").alias("verbatim")))
    return out.where(F.col("n_matched") >= F.col("n_windows") * F.lit(min_coverage)).select(
        "doc_id", "__row", "item_id", "n_matched", "n_windows", "verbatim")


def whole_words(text: Column) -> Column:
    """array<struct<t, v, s, e>>: canonical words as in ``canonical``, but a sign that stands
    alone is a word ("12 + 7" is not "12 - 7"), and a word that opens a line is no name; s and e
    tell whether a sentence or line starts at the word and ends with it."""
    newline = F.lit("\n")
    raw = F.filter(F.split(F.replace(text, newline, F.lit(" \n ")), "[\\x20\\x09\\x0B-\\x0D]+"), lambda w: w != F.lit(""))

    def words(r: Column) -> Column:
        at = lambda i: F.coalesce(F.get(r, i), newline)
        return F.transform(r, lambda w, i: let(F.when(i == 0, F.lit(True)).otherwise(
            (at(F.greatest(i - 1, F.lit(0))) == newline) | at(F.greatest(i - 1, F.lit(0))).rlike(SENTENCE_END)), lambda s: let(_typed(w, s), lambda x: F.struct(
                x["t"].alias("t"), x["v"].alias("v"), s.alias("s"), ((at(i + 1) == newline) | w.rlike(SENTENCE_END)).alias("e")))))

    return F.filter(let(raw, words), lambda w: w["t"] != newline)


def _typed(raw: Column, opens: Column) -> Column:
    return let(F.regexp_replace(raw, EDGES, ""), lambda w: let(F.lower(w), lambda x: F.when(
        w == F.lit(""), F.struct(raw.alias("t"), F.lit(None).cast("string").alias("v"))).when(
        x.rlike(NUMBER), F.struct(F.lit("<num>").alias("t"), x.alias("v"))).when(
        x.rlike(UNIT), F.struct(F.lit("<unit>").alias("t"), x.alias("v"))).when(
        w.rlike(NAME) & ~opens, F.struct(F.lit("<name>").alias("t"), x.alias("v"))).otherwise(
        F.struct(x.alias("t"), F.lit(None).cast("string").alias("v")))))


def _without_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, item) of the items that have no usable window, as whole words."""
    items = materialize(item_windows(benchmark).select(F.col("item_id").alias("__item")).distinct(), "items-with-windows")
    return (benchmark.select("item_id", "text").join(items, benchmark["item_id"].eqNullSafe(items["__item"]), "left_anti")
                     .select("item_id", whole_words(F.col("text").cast("string")).alias("item")).distinct())


def unmatched_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, n_words) of the items that are looked for nowhere: without a word, or of one."""
    return _without_windows(benchmark).select("item_id", F.greatest(F.coalesce(F.size("item"), F.lit(0)), F.lit(0)).alias("n_words")).where("n_words < 2")


def whole_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, __row, item_id, verbatim) of the documents that hold an item without a usable
    window. Up to ``WIDTH`` first words of an item find candidates by hash, then all words and
    the places around are compared. Without such items no document is read."""
    head = F.least(F.size("item"), F.lit(WIDTH))
    names = lambda w: F.transform(w, lambda x: x["t"])
    h = F.coalesce(*[F.when(head == n, F.element_at(window_hashes(names(F.slice("item", 1, n)), n), 1)) for n in range(2, WIDTH + 1)])
    items = materialize(_without_windows(benchmark).where(F.size("item") >= 2).select("item_id", "item", h.alias("h"), head.alias("width")), "whole-items")
    widths = [r[0] for r in items.select("width").distinct().collect()]          # at most WIDTH values
    d = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("__row"), F.col("text").cast("string").alias("text"))
    if not widths:
        return d.where(F.lit(False)).select("doc_id", "__row", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"),
                                            F.lit(True).alias("verbatim"))
    at = let(names(whole_words(F.col("text"))), lambda w: F.concat(*[
        F.transform(window_hashes(w, n), lambda x, j: F.struct(x.alias("h"), j.alias("j"))) for n in sorted(widths)]))
    # Hashes only over all documents; words are read again in those with a candidate.
    hits = (d.select("doc_id", "__row", F.explode(at).alias("x")).select("doc_id", "__row", "x.h", "x.j")
             .join(items.select("h").distinct(), "h", "left_semi").distinct())
    hits = materialize(hits.select(F.col("doc_id").alias("__id"), F.col("__row").alias("__hit"), "h", "j"), "whole-candidates")
    both = (d.join(hits, (d["__row"] == hits["__hit"]) & d["doc_id"].eqNullSafe(hits["__id"])).join(items, "h")
             .select("doc_id", "__row", "item_id", "item", F.slice(whole_words(F.col("text")), F.col("j") + 1, F.size("item")).alias("part"))
             .where(names(F.col("part")) == names(F.col("item"))))
    pairs = F.filter(F.transform(F.arrays_zip(F.col("item").alias("b"), F.col("part").alias("d")), lambda p: F.struct(
        p["b"]["v"].alias("b"), p["d"]["v"].alias("d"))), lambda p: p["b"].isNotNull())
    both = both.select("doc_id", "__row", "item_id", F.size("item").alias("n"), pairs.alias("z"),
                       F.size(F.filter("item", lambda w: w["v"].isNull())).alias("literal"),
                       (F.get("part", F.lit(0))["s"] & F.element_at("part", -1)["e"]).alias("alone"))
    both = both.withColumn("same", F.forall("z", lambda p: p["b"] == p["d"]))
    consistent = F.size(F.array_distinct("z")) == F.size(F.array_distinct(F.transform("z", lambda p: p["b"])))
    other = consistent & ((F.col("literal") >= SURE_LITERALS) | (F.col("alone") & (F.col("literal") >= BOUND_LITERALS)))
    found = both.where(F.when(F.col("n") < MIN_WORDS, F.col("same") & F.col("alone")).otherwise(F.col("same") | other))
    return found.groupBy("doc_id", "__row", "item_id").agg(F.bool_or("same").alias("verbatim"))


def all_leaks(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """``leaks``, and the items matched whole (one window, matched)."""
    one = F.lit(1).cast("long")
    found = leaks(docs, benchmark, min_coverage)
    whole = whole_leaks(docs, benchmark).select("doc_id", "__row", "item_id", one.alias("n_matched"), one.alias("n_windows"), "verbatim")
    return found.unionByName(whole)


def report(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    return all_leaks(docs, benchmark, min_coverage).drop("__row")


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """The documents in which no item is leaked, with all their columns."""
    found = all_leaks(docs, benchmark, min_coverage).select("doc_id", "__row")
    bad = found.select(F.col("doc_id").alias("__id"), F.col("__row").alias("__bad")).distinct()
    bad = materialize(bad, "leaky-documents")
    own = F.xxhash64(docs["doc_id"], docs["text"])
    return docs.join(bad, (own == bad["__bad"]) & docs["doc_id"].eqNullSafe(bad["__id"]), "left_anti")


# The report in DuckDB SQL, stated on its own.
REPORT_SQL = r"""
WITH src AS (SELECT 'd' AS side, k, id, text FROM (SELECT row_number() OVER () AS k, doc_id AS id, text FROM documents)
             UNION ALL SELECT 'b', k, id, text FROM (SELECT row_number() OVER () AS k, item_id AS id, text FROM benchmark)),
r AS (SELECT side, k, id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS r FROM src WHERE text IS NOT NULL),
t0 AS (SELECT side, k, id, unnest(r) AS raw, generate_subscripts(r, 1) AS p FROM r),
t1 AS (SELECT *, regexp_replace(raw, '^[^\p{L}\p{N}+\-$€£%°]+|[^\p{L}\p{N}%°$€£]+$', '', 'g') AS w,
              coalesce(regexp_matches(lag(raw) OVER (PARTITION BY side, k ORDER BY p), '[.!?:]["''”’)\]]*$'), true) AS opens FROM t0),
t2 AS (SELECT *, lower(w) AS x FROM t1),
t3 AS (SELECT side, k, id, p, x, CASE
         WHEN regexp_matches(x, '^[+\-$€£]*[0-9][0-9.,:/]*(st|nd|rd|th|%|°|°c|°f|km|cm|mm|kg|mg|ml|kmh|mph|k|m|g|s|h|x|usd|eur)?$|^(two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion)$') THEN '<num>'
         WHEN regexp_matches(x, '^(km|cm|mm|kg|mg|ml|km/h|mph|kmh|%|\$|€|£|usd|eur|dollars?|euros?|pounds?|cents?|meters?|metres?|kilometers?|kilometres?|miles?|feet|foot|inch|inches|yards?|grams?|kilograms?|liters?|litres?|gallons?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|degrees?|percent)$') THEN '<unit>'
         WHEN regexp_matches(w, '^\p{Lu}\p{Ll}+(?:[-''’]\p{L}+)*$') AND NOT opens THEN '<name>' ELSE x END AS t FROM t2),
t4 AS (SELECT side, k, id, t, CASE WHEN t IN ('<num>', '<unit>', '<name>') THEN x END AS v,
              row_number() OVER (PARTITION BY side, k ORDER BY p) - 1 AS p, count(*) OVER (PARTITION BY side, k) AS n
       FROM t3 WHERE t <> ''),
sz AS (SELECT DISTINCT least(n, 8) AS width FROM t4 WHERE side = 'b' AND n >= 4),
win AS (SELECT side, k, id, p, n, width,
               list({'t': t, 'v': v}) OVER (PARTITION BY side, k, width ORDER BY p ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)[1:width] AS s
        FROM t4, sz),
wn AS (SELECT side, k, id, p, n, width, list_transform(s, lambda e: e.t) AS h,
              list_transform(list_filter(s, lambda e: e.v IS NOT NULL), lambda e: e.v) AS slots FROM win WHERE p + width <= n),
bw AS (SELECT DISTINCT id AS item_id, p AS i, width, h, slots FROM wn
       WHERE side = 'b' AND n >= 4 AND width = least(n, 8) AND (width - len(slots)) * 8 >= 5 * width),
bt AS (SELECT item_id, count(DISTINCT i) AS n_windows FROM bw GROUP BY item_id),
z AS (SELECT d.id AS doc_id, d.k, b.item_id, b.i, d.p - b.i AS diagonal, b.slots AS bs, d.slots AS ds
      FROM wn d JOIN bw b ON d.side = 'd' AND d.h = b.h AND d.width = b.width),
zp AS (SELECT doc_id, k, item_id, diagonal, unnest(bs) AS b, unnest(ds) AS v FROM z),
bad AS (SELECT DISTINCT doc_id, k, item_id, diagonal FROM zp GROUP BY doc_id, k, item_id, diagonal, b HAVING count(DISTINCT v) > 1),
chg AS (SELECT DISTINCT doc_id, k, item_id, diagonal FROM zp WHERE b <> v),
ok AS (SELECT z.doc_id, z.k, z.item_id, z.i, chg.k IS NULL AS same FROM z
       LEFT JOIN bad ON bad.k = z.k AND bad.item_id IS NOT DISTINCT FROM z.item_id AND bad.diagonal = z.diagonal
       LEFT JOIN chg ON chg.k = z.k AND chg.item_id IS NOT DISTINCT FROM z.item_id AND chg.diagonal = z.diagonal WHERE bad.k IS NULL),
wt AS (SELECT side, k, id, unnest(r) AS raw, generate_subscripts(r, 1) AS p FROM (SELECT side, k, id,
         list_filter(string_split_regex(replace(text, chr(10), ' ' || chr(10) || ' '), '[\x20\x09\x0B-\x0D]+'), lambda x: x <> '') AS r
         FROM src WHERE text IS NOT NULL)),
wf AS (SELECT *, coalesce(lag(raw) OVER w = chr(10) OR regexp_matches(lag(raw) OVER w, '[.!?:]["''”’)\]]*$'), true) AS s,
              coalesce(lead(raw) OVER w, chr(10)) = chr(10) OR regexp_matches(raw, '[.!?:]["''”’)\]]*$') AS e FROM wt WINDOW w AS (PARTITION BY side, k ORDER BY p)),
wx AS (SELECT *, lower(w) AS x FROM (SELECT *, regexp_replace(raw, '^[^\p{L}\p{N}+\-$€£%°]+|[^\p{L}\p{N}%°$€£]+$', '', 'g') AS w FROM wf WHERE raw <> chr(10))),
wy AS (SELECT side, k, id, p, s, e, x, CASE WHEN w = '' THEN raw WHEN regexp_matches(x, '^[+\-$€£]*[0-9][0-9.,:/]*(st|nd|rd|th|%|°|°c|°f|km|cm|mm|kg|mg|ml|kmh|mph|k|m|g|s|h|x|usd|eur)?$|^(two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion)$') THEN '<num>'
         WHEN regexp_matches(x, '^(km|cm|mm|kg|mg|ml|km/h|mph|kmh|%|\$|€|£|usd|eur|dollars?|euros?|pounds?|cents?|meters?|metres?|kilometers?|kilometres?|miles?|feet|foot|inch|inches|yards?|grams?|kilograms?|liters?|litres?|gallons?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|degrees?|percent)$') THEN '<unit>' WHEN regexp_matches(w, '^\p{Lu}\p{Ll}+(?:[-''’]\p{L}+)*$') AND NOT s THEN '<name>' ELSE x END AS t FROM wx),
ww AS (SELECT side, k, id, list({'t': t, 'v': CASE WHEN t IN ('<num>', '<unit>', '<name>') THEN x END, 's': s, 'e': e} ORDER BY p) AS l
       FROM wy GROUP BY side, k, id),
wi AS (SELECT DISTINCT id AS item_id, l AS item FROM ww WHERE side = 'b' AND len(l) >= 2
       AND NOT EXISTS (SELECT 1 FROM bw WHERE bw.item_id IS NOT DISTINCT FROM ww.id)),
wp AS (SELECT doc_id, k, item_id, item, l[j:j + len(item) - 1] AS part FROM
         (SELECT ww.id AS doc_id, ww.k, ww.l, wi.item_id, wi.item, unnest(range(1, len(ww.l) - len(wi.item) + 2)) AS j FROM ww, wi WHERE ww.side = 'd')),
wq AS (SELECT doc_id, k, item_id, len(item) AS n, len(list_filter(item, lambda y: y.v IS NULL)) AS literal, part[1].s AND part[-1].e AS alone,
              list_filter(list_zip(list_transform(item, lambda y: y.v), list_transform(part, lambda y: y.v)), lambda y: y[1] IS NOT NULL) AS z
       FROM wp WHERE list_transform(item, lambda y: y.t) = list_transform(part, lambda y: y.t)),
wh AS (SELECT doc_id, k, item_id, bool_or(same) AS verbatim FROM
         (SELECT *, len(list_filter(z, lambda y: y[1] <> y[2])) = 0 AS same,
                 len(list_distinct(z)) = len(list_distinct(list_transform(z, lambda y: y[1]))) AS consistent FROM wq)
       WHERE CASE WHEN n < 4 THEN same AND alone ELSE same OR (consistent AND (literal >= 4 OR (alone AND literal >= 2))) END
       GROUP BY doc_id, k, item_id)
SELECT DISTINCT * FROM (
  SELECT doc_id, ok.item_id, CAST(count(DISTINCT i) AS BIGINT) AS n_matched, any_value(n_windows) AS n_windows, bool_and(same) AS verbatim
  FROM ok JOIN bt ON bt.item_id IS NOT DISTINCT FROM ok.item_id GROUP BY doc_id, ok.k, ok.item_id)
WHERE n_matched >= 0.5 * n_windows
UNION ALL SELECT doc_id, item_id, 1::BIGINT AS n_matched, 1::BIGINT AS n_windows, verbatim FROM
  (SELECT DISTINCT wh.doc_id, d.text, wh.item_id, wh.verbatim FROM wh JOIN (SELECT k, text FROM src WHERE side = 'd') d USING (k))
"""
