"""I-Match document fingerprints with randomised lexicon subsets.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. The lexicon holds
the terms in the inverse-document-frequency band [ln ``WIDEST``, ln ``RAREST``]: they stand
in two documents at least, in at most one of ``WIDEST`` and in at least one of ``RAREST``
documents. A text's distinct lexicon terms are sorted by code (the start of their MD5) and
hashed per lexicon subset: ``SUBSETS`` random subsets split the lexicon, and level l keeps a
random ``4 ** -l`` of it. A text takes the level that leaves it at most ``SAMPLE`` of its
distinct terms, and the next sparser one, so long and short texts both have subsets with few
terms, which survive an edit elsewhere in the text. A fingerprint reads ``level:`` and one
four-digit hash per subset of its two levels (``....`` where the text has no term).

``likeness`` compares the levels two fingerprints share: equal hashes over subsets in which
either has a term; 0 where they share no level. Equal fingerprints have likeness 1.

On Spark, all of it column expressions and DataFrame operators. Document frequencies are one
aggregation over all texts. The lexicon has at most ``RAREST`` times a document's mean
number of distinct terms, whatever the number of documents; it is counted, broadcast up to
``MAX_BROADCAST`` terms, and joined by shuffle beyond. For "the next document", rows are dealt to buckets of
consecutive ids (at most ``MAX_BUCKETS`` cut points, read once), each with a copy of the
following bucket's first row, so one shuffle of the texts serves the neighbour, the
fingerprints (grouped by the same bucket) and the comparison with the neighbour's.

Edge cases: null text is empty; a text without lexicon terms has ``x`` and the MD5 of the
whole text as its fingerprint, so equal texts still agree and others have likeness 0; rows
go by doc_id (null first), then text, so repeated rows follow each other; one row alone is
its own next; very long texts are taken whole, at a sparser level; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ludex.session import materialize

WIDEST, RAREST = 10, 2000
SUBSETS = 32
SAMPLE = 128
BUCKET_ROWS = 1000
MAX_BUCKETS = 10_000
MAX_BROADCAST = 2_000_000        # lexicon terms (under 200 MB) up to which the lexicon is broadcast
# A code is in level l if it sorts before this: a share of 4 ** -l of all hex strings.
LEVEL_BOUNDS = ("g", "4", "1", "04", "01", "004", "001", "0004", "0001")
EMPTY_SLOT = "...."
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text: Column) -> Column:
    """Distinct terms of a text."""
    return F.array_remove(F.array_distinct(F.split(F.translate(text, UPPER, LOWER), NO_TERM)), "")


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, whatever number of times it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _level(n_terms: Column) -> Column:
    out = F.when(n_terms <= SAMPLE, 0)
    for level in range(1, len(LEVEL_BOUNDS) - 2):
        out = out.when(n_terms <= SAMPLE * 4 ** level, level)
    return out.otherwise(len(LEVEL_BOUNDS) - 2)


def _bound(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVEL_BOUNDS)), level + 1)


def lexicon(docs: DataFrame) -> DataFrame:
    """(term, code) of the terms in the band, over all documents."""
    n = docs.select(F.count(F.lit(1))).scalar()
    found = docs.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("docs"))
    band = (F.col("docs") >= 2) & (F.col("docs") * RAREST >= n) & (F.col("docs") <= F.greatest(F.lit(2), F.floor(n / F.lit(WIDEST))))
    return found.where(band).select("term", F.substring(F.md5("term"), 1, 16).alias("code"))


def sampled(text: Column) -> Column:
    """(level, terms): the level of a text, and its distinct terms of that level."""
    def pick(found: Column) -> Column:
        level = _level(F.size(found))
        return F.struct(level.alias("level"), once(_bound(level), lambda b: F.filter(found, lambda t: F.md5(t) < b)).alias("terms"))
    return once(terms_of(text), pick)


def fingerprint(codes: Column, level: Column, text_md5: Column) -> Column:
    """The fingerprint of a text with these lexicon codes at its level."""
    def slots(ordered: Column) -> Column:
        def slot(i: Column) -> Column:
            # The first half is the text's level, the second the next sparser one.
            sparse = i >= SUBSETS
            mine = F.filter(ordered, lambda c: (c["subset"] == i % SUBSETS) & (~sparse | (c["code"] < _bound(level + 1))))
            joined = F.array_join(F.transform(mine, lambda c: c["code"]), ",")
            return once(joined, lambda s: F.when(s == "", EMPTY_SLOT).otherwise(F.substring(F.md5(s), 1, len(EMPTY_SLOT))))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2 * SUBSETS - 1)), slot), "")

    subset = lambda c: F.conv(F.substring(c, 9, 2), 16, 10).cast("int") % SUBSETS
    ordered = F.transform(F.array_sort(codes), lambda c: F.struct(c.alias("code"), subset(c).alias("subset")))
    return F.when(F.size(codes) == 0, F.concat(F.lit("x"), text_md5)).otherwise(
        F.concat(level.cast("string"), F.lit(":"), once(ordered, slots)))


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing subsets of two fingerprints, over those in which either has a term."""
    width = len(EMPTY_SLOT)
    half = SUBSETS * width
    body = lambda x, part: F.substring(x, 3 + part * half, half)
    level = lambda x: F.substring(x, 1, 1).try_cast("int")
    x = F.when(level(a) == level(b), F.substring(a, 3, 2 * half)).when(level(a) == level(b) + 1, body(a, 0)).when(level(b) == level(a) + 1, body(a, 1))
    y = F.when(level(a) == level(b), F.substring(b, 3, 2 * half)).when(level(a) == level(b) + 1, body(b, 1)).when(level(b) == level(a) + 1, body(b, 0))

    def share(p: Column) -> Column:
        at = F.sequence(F.lit(0), (F.length(p["x"]) / width).cast("int") - 1)
        cut = lambda s, i: F.substr(s, i * width + 1, F.lit(width))
        used = F.filter(at, lambda i: (cut(p["x"], i) != EMPTY_SLOT) | (cut(p["y"], i) != EMPTY_SLOT))
        return once(used, lambda u: F.when(F.size(u) == 0, 0.0).otherwise(
            F.size(F.filter(u, lambda i: cut(p["x"], i) == cut(p["y"], i))) / F.size(u)))

    comparable = level(a).isNotNull() & level(b).isNotNull() & (F.abs(level(a) - level(b)) <= 1)
    return F.when(a == b, 1.0).when(comparable, once(F.struct(x.alias("x"), y.alias("y")), share)).otherwise(0.0)


def _bucketed(docs: DataFrame) -> DataFrame:
    """Rows with their bucket of consecutive ids; the first row of the next bucket (of the
    first one, for the last) comes along as a ``ghost``."""
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids"), F.min("doc_id").alias("least")).first()
    n = min(max(1, -(-size.n // BUCKET_ROWS)), MAX_BUCKETS)
    cuts = []
    if n > 1 and size.ids:
        found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("c")).first().c
        cuts = sorted({c for c in found if c > size.least})             # at most MAX_BUCKETS numbers
    first = F.lit(None if size.ids < size.n else size.least).cast("long")
    id_ = F.col("doc_id")
    # Two steps of about the square root of the number of cut points.
    step = max(1, int(len(cuts) ** 0.5))
    coarse = F.lit(cuts[step - 1::step]).cast("array<long>") if cuts else F.array().cast("array<long>")
    fine = F.lit(cuts).cast("array<long>") if cuts else F.array().cast("array<long>")
    passed = F.size(F.filter(coarse, lambda c: c <= id_)) * step
    bucket = F.when(id_.isNull(), 0).otherwise(passed + F.size(F.filter(F.slice(fine, passed + 1, step), lambda c: c <= id_)))
    place = lambda b, ghost: F.struct(b.cast("int").alias("bucket"), F.lit(ghost).alias("ghost"))
    opens = F.array_contains(fine, F.coalesce(id_, F.lit(-1))) & id_.isNotNull()

    def places(b: Column) -> Column:
        own = F.array(place(b, False))
        own = F.when(opens, F.concat(own, F.array(place(b - 1, True)))).otherwise(own)
        return F.when(id_.eqNullSafe(first), F.concat(own, F.array(place(F.lit(len(cuts)), True)))).otherwise(own)

    return docs.withColumn("place", F.explode(once(bucket, places))).select("place.bucket", "place.ghost", "doc_id", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next) of every document, as the query's contract has it."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = materialize(lexicon(docs), "lexicon")
    words = F.broadcast(words) if words.count() <= MAX_BROADCAST else words
    order = Window.partitionBy("bucket").orderBy("ghost", "doc_id", "text")
    rows = _bucketed(docs).select("bucket", "ghost", "doc_id", "text", F.row_number().over(order).alias("place"),
                                  F.coalesce(F.lead("text").over(order), F.lit("")).alias("next"), F.length("text").alias("n_chars"))
    taken = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars") - taken), F.substr("next", F.lit(1), taken)))

    entry = lambda which, term, note, level: F.struct(
        F.lit(which).alias("which"), term.alias("term"), note.cast("string").alias("note"), level.cast("int").alias("level"))
    none = F.lit(None)
    # Notes are no terms (these have no digits), and all differ, so no join key is hot.
    note = lambda which, value, level: entry(which, F.concat(F.lit("0"), value), value, level)

    def entries(which: int, text: Column) -> Column:
        return once(sampled(text), lambda s: F.concat(F.array(note(which + 2, F.md5(text), s["level"])),
                                                      F.transform(s["terms"], lambda t: entry(which, t, none, none))))

    all_ = F.concat(F.array(note(0, F.sha2("edited", 256), none)), entries(1, F.col("text")), entries(2, F.col("edited")))
    found = rows.select("bucket", "place", "ghost", "doc_id", "n_chars", F.explode(all_).alias("e")).select(
        "bucket", "place", "ghost", "doc_id", "n_chars", "e.*")
    found = found.join(words, "term", "left").where(F.col("code").isNotNull() | F.col("note").isNotNull())
    of = lambda which, c: F.when(F.col("which") == which, F.col(c))
    grouped = found.groupBy("bucket", "place", "ghost", "doc_id", "n_chars").agg(
        F.max(of(0, "note")).alias("edited_sha256"),
        *[f for i in (1, 2) for f in (F.collect_list(of(i, "code")).alias(f"codes{i}"), F.max(of(i + 2, "note")).alias(f"md5{i}"),
                                      F.max(of(i + 2, "level")).alias(f"level{i}"))])
    made = grouped.select("bucket", "place", "ghost", "doc_id", "n_chars", "edited_sha256",
                          fingerprint(F.col("codes1"), F.col("level1"), F.col("md51")).alias("fingerprint"),
                          fingerprint(F.col("codes2"), F.col("level2"), F.col("md52")).alias("edited_fingerprint"))
    by_place = Window.partitionBy("bucket").orderBy("place")
    made = made.withColumn("next_fingerprint", F.lead("fingerprint").over(by_place)).where(~F.col("ghost"))
    return made.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


FINGERPRINTS_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS rn, doc_id, coalesce(text, '') AS text FROM documents),
neighbours AS (SELECT *, length(text) AS n_chars, coalesce(lead(text) OVER (ORDER BY rn), first_value(text) OVER (ORDER BY rn)) AS next FROM d),
e AS (SELECT rn, doc_id, n_chars, text, left(text, n_chars - n_chars // 4) || left(next, n_chars // 4) AS edited FROM neighbours),
texts AS (SELECT rn, 1 AS which, text AS t FROM e UNION ALL SELECT rn, 2 AS which, edited AS t FROM e),
terms AS (SELECT DISTINCT rn, which, term FROM (SELECT rn, which, unnest(regexp_split_to_array(
    translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts) WHERE term <> ''),
lexicon AS (SELECT term, left(md5(term), 16) AS code FROM terms WHERE which = 1 GROUP BY term
    HAVING count(*) >= 2 AND count(*) * 2000 >= (SELECT count(*) FROM documents)
        AND count(*) <= greatest(2, (SELECT count(*) FROM documents) // 10)),
levels AS (SELECT rn, which, CASE WHEN n <= 128 THEN 0 WHEN n <= 512 THEN 1 WHEN n <= 2048 THEN 2 WHEN n <= 8192 THEN 3
    WHEN n <= 32768 THEN 4 WHEN n <= 131072 THEN 5 WHEN n <= 524288 THEN 6 ELSE 7 END AS level
    FROM (SELECT rn, which, count(*) AS n FROM terms GROUP BY rn, which)),
bounds AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS level, unnest(['g', '4', '1', '04', '01', '004', '001', '0004', '0001']) AS bound),
coded AS (SELECT t.rn, t.which, l.level, x.code, ('0x' || substr(x.code, 9, 2))::INTEGER % 32 AS subset
    FROM terms t JOIN lexicon x USING (term) JOIN levels l ON l.rn = t.rn AND l.which = t.which
    JOIN bounds b ON b.level = l.level AND x.code < b.bound),
slots AS (SELECT c.rn, c.which, c.subset + 32 * h.half AS slot, left(md5(string_agg(c.code, ',' ORDER BY c.code)), 4) AS sig
    FROM coded c CROSS JOIN (SELECT unnest([0, 1]) AS half) h JOIN bounds b ON b.level = c.level + h.half AND c.code < b.bound GROUP BY ALL),
used AS (SELECT DISTINCT rn, which, level FROM coded),
prints AS (SELECT u.rn, u.which, u.level || ':' || string_agg(coalesce(s.sig, '....'), '' ORDER BY r.i) AS fp
    FROM used u CROSS JOIN (SELECT unnest(range(64)) AS i) r LEFT JOIN slots s ON s.rn = u.rn AND s.which = u.which AND s.slot = r.i
    GROUP BY u.rn, u.which, u.level),
fps AS (SELECT t.rn, t.which, coalesce(p.fp, 'x' || md5(t.t)) AS fp FROM texts t LEFT JOIN prints p ON p.rn = t.rn AND p.which = t.which),
own AS (SELECT e.rn, e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint
    FROM e JOIN fps a ON a.rn = e.rn AND a.which = 1 JOIN fps b ON b.rn = e.rn AND b.which = 2),
pairs AS (SELECT rn, 'edited' AS kind, fingerprint AS a, edited_fingerprint AS b FROM own
    UNION ALL SELECT rn, 'next', fingerprint, coalesce(lead(fingerprint) OVER (ORDER BY rn), first_value(fingerprint) OVER (ORDER BY rn)) FROM own),
leveled AS (SELECT *, try_cast(left(a, 1) AS INTEGER) AS la, try_cast(left(b, 1) AS INTEGER) AS lb FROM pairs),
cut AS (SELECT rn, kind, a, b,
    CASE WHEN la = lb THEN substr(a, 3, 256) WHEN la = lb + 1 THEN substr(a, 3, 128) WHEN lb = la + 1 THEN substr(a, 131, 128) ELSE '' END AS x,
    CASE WHEN la = lb THEN substr(b, 3, 256) WHEN la = lb + 1 THEN substr(b, 131, 128) WHEN lb = la + 1 THEN substr(b, 3, 128) ELSE '' END AS y FROM leveled),
compared AS (SELECT rn, kind, sum((substr(x, i * 4 + 1, 4) = substr(y, i * 4 + 1, 4))::INTEGER) AS same, count(*) AS used
    FROM cut CROSS JOIN (SELECT unnest(range(64)) AS i) r
    WHERE i * 4 < length(x) AND (substr(x, i * 4 + 1, 4) <> '....' OR substr(y, i * 4 + 1, 4) <> '....') GROUP BY rn, kind),
near AS (SELECT c.rn, c.kind, CASE WHEN c.a = c.b THEN 1.0::DOUBLE WHEN k.used IS NULL THEN 0.0::DOUBLE ELSE k.same / k.used END AS near
    FROM cut c LEFT JOIN compared k ON k.rn = c.rn AND k.kind = c.kind)
SELECT o.doc_id, o.n_chars::BIGINT AS n_chars, o.edited_sha256, o.fingerprint, o.edited_fingerprint,
    x.near::DOUBLE AS near_edited, y.near::DOUBLE AS near_next
FROM own o JOIN near x ON x.rn = o.rn AND x.kind = 'edited' JOIN near y ON y.rn = o.rn AND y.kind = 'next'
"""
