"""Line dedup by a fixed-depth template tree, as DataFrame expressions only.

A line falls to a leaf of the tree by its token count and its ``DEPTH`` leading tokens,
tokens that vary by nature (with a digit, ``@`` or ``://``) masked as one wildcard. Leaves
met in fewer than ``min_docs`` documents hold no recurring line and stop there. In the
others a line has several templates: itself, masked; and, for every level k that one of its
tokens reaches, the form in which tokens of level k and more are constant and the rest are
wildcards. A token's level is the power of two in its support: at its position in the leaf it
stands in ``min_docs * 2 ** level`` lines at least. So a leaf holds as many templates as its
lines have, whatever else it holds: what a template keeps constant has at least the template's
support, and a value that varies has less, or is frequent enough to make a template of its
own. A template met in at least ``min_docs`` documents with at least ``MIN_CONSTANT`` of its
tokens constant (``DEPTH + MIN_TAIL`` of them, if it has wildcards of this kind) is recurring,
and its lines are dropped from every document.

Only a whole copy keeps them: a document that would lose more than half of its characters and
has the same set of lines as another one, which is for document dedup to settle. Lines of
fewer than ``MIN_TOKENS`` tokens say too little to tell a template from chance and stay.

With ``long_docs`` (the pipeline's stage), every document that would lose more than half is
taken as a copy, near ones too; and lines that recur surely go from every document: those that
stand in enough documents, of which at least half are unlike each other. Enough are
``min_docs``, or ``long_docs`` (``LONG_UNLIKE`` unlike) for a line that does not repeat by
chance: two of n lines of k tokens are equal by chance with a probability under
``n^2 / 2 / 2 ** (TOKEN_BITS * k)``, so k must bring that below ``2 ** -CHANCE_BITS``
(``surely_long``). Documents are alike where the least hash of their other lines agrees
(``SEEDS`` hashes, of which ``DOUBT`` may say otherwise). Lines of copies are not among them.

Scale: lines are first counted by hash; counts per leaf, line, token and template are
pre-aggregated map-side, and joins back to them read written tables, so that adaptive
execution can broadcast a small side by its size or split a hot leaf. Texts are shuffled
once, to drop the lines.

Edge cases: null or empty text is unchanged; a line repeated inside one document counts
once; rows with one doc_id count as one document, and so do rows without doc_id; repeated
rows are all returned; very long texts and lines are taken whole; an empty table gives no rows.
Every input column is returned as it is, whatever its name (the input travels as one struct),
but for ``text`` and, where there is one, ``n_chars`` of changed documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ludex.session import materialize

DEPTH = 3
MIN_TOKENS = 4
MIN_DOCS = 20
MIN_CONSTANT = 0.6
MIN_TAIL = 2                # constant tokens behind the leading ones in a template with wildcards
TOKEN_BITS = 8              # what a token of running text tells, at least
CHANCE_BITS = 20            # chance that no line of the corpus repeats in running text: 1 - 2 ** -20
LONG_DOCS = 3
LONG_UNLIKE = 2
SEEDS = 16
DOUBT = 2

SPACE = "[\\x20\\x09-\\x0D]+"
VARIABLE = "[0-9@]|://"
WILDCARD = "<*>"
NO_ID = -(1 << 63)


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def line_tokens(line: Column) -> Column:
    return F.array_remove(F.split(line, SPACE), "")


def masked(words: Column) -> Column:
    return F.transform(words, lambda w: F.when(w.rlike(VARIABLE), F.lit(WILDCARD)).otherwise(w))


def masked_tokens(line: Column) -> Column:
    """The line's tokens, masked; tokens are looked at one by one only where the line holds one
    that varies."""
    words = line_tokens(line)
    return F.when(line.rlike(VARIABLE), masked(words)).otherwise(words)


def _keys(docs: DataFrame) -> list[Column]:
    """Document id (null: one reserved id) and a hash that tells rows of one id apart."""
    return [F.coalesce(docs["doc_id"], F.lit(NO_ID)).alias("__id"), F.xxhash64(docs["doc_id"], docs["text"]).alias("__row")]


def leaves_of(docs: DataFrame) -> DataFrame:
    """(leaf, __id) of the lines of enough tokens, once per row of ``docs``. Leaves are counted
    before anything else of a line is worked out."""
    def leaf(s: Column) -> Column:
        return let(line_tokens(s), lambda w: F.when(F.size(w) >= MIN_TOKENS, F.xxhash64(F.size(w), masked(F.slice(w, 1, DEPTH)))))

    found = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), leaf), lambda h: h.isNotNull()))
    return docs.where(F.length("text") > 0).select(_keys(docs)[0], F.explode(found).alias("leaf"))


def lines_of(docs: DataFrame) -> DataFrame:
    """(__id, __row, line_no, leaf, line_hash, masked, chars, __doc) of lines of enough tokens;
    __doc tells of the document: its length, number of lines and the hash of its set of lines."""
    def line(s: Column) -> Column:
        return let(masked_tokens(s), lambda w: F.when(F.size(w) >= MIN_TOKENS, F.struct(
            F.xxhash64(F.size(w), F.slice(w, 1, DEPTH)).alias("leaf"), F.xxhash64(w).alias("line_hash"), w.alias("masked"),
            F.length(s).alias("chars"))))

    def doc(ls: Column) -> Column:
        same = F.sort_array(F.array_distinct(F.transform(F.filter(ls, lambda x: x.isNotNull()), lambda x: x["line_hash"])))
        return F.struct(F.size(ls).alias("lines"), F.xxhash64(same).alias("set")).alias("doc")

    found = let(F.transform(F.split("text", "\n"), line), lambda ls: F.struct(doc(ls), ls.alias("ls")))
    rows = docs.where(F.length("text") > 0).select(*_keys(docs), F.length("text").alias("__length"), found.alias("__f")).select(
        "__id", "__row", F.struct(F.col("__length").alias("length"), "__f.doc.lines", "__f.doc.set").alias("__doc"),
        F.posexplode("__f.ls").alias("line_no", "x"))
    return rows.where(F.col("x").isNotNull()).select("__id", "__row", "line_no", "x.leaf", "x.line_hash", "x.masked", "x.chars", "__doc")


def line_forms(distinct: DataFrame, min_docs: int) -> DataFrame:
    """(leaf, line_hash, template) of the lines' forms with wildcards, one per level that a
    line's tokens reach. ``distinct`` has (leaf, line_hash, n, masked)."""
    places = distinct.select("leaf", "line_hash", "n", F.posexplode("masked").alias("pos", "token"))
    support = (places.where(F.col("token") != WILDCARD).groupBy("leaf", "pos", "token").agg(F.sum("n").alias("support"))
                     .where(F.col("support") >= min_docs)
                     .select("leaf", "pos", "token", (F.length(F.bin(F.floor(F.col("support") / min_docs))) - 1).alias("level")))
    support = materialize(support, "frequent-tokens")
    tokens = (places.join(support, ["leaf", "pos", "token"], "left").groupBy("leaf", "line_hash")
                    .agg(F.sort_array(F.collect_list(F.struct("pos", "token", F.coalesce("level", F.lit(-1)).alias("level")))).alias("t")))
    levels = F.array_distinct(F.filter(F.transform("t", lambda x: x["level"]), lambda k: k >= 0))
    return tokens.select("leaf", "line_hash", "t", F.explode(levels).alias("k")).select("leaf", "line_hash", F.transform(
        "t", lambda x: F.when(x["level"] >= F.col("k"), x["token"]).otherwise(F.lit(WILDCARD))).alias("template"))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(__id, __row, line_no, chars, __doc) of every line whose template recurs."""
    lines = lines_of(docs)
    leaves = (leaves_of(docs).distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
                   .where(F.col("n") >= min_docs).select("leaf"))
    leaves = materialize(leaves, "leaves")
    kept = materialize(lines.join(leaves, "leaf"), "leaf-lines")
    distinct = (kept.select("leaf", "line_hash", "__id", "masked").groupBy("leaf", "line_hash", "__id")
                    .agg(F.first("masked").alias("masked")).groupBy("leaf", "line_hash")
                    .agg(F.count(F.lit(1)).alias("n"), F.first("masked").alias("masked")))
    distinct = materialize(distinct, "distinct-lines")
    constant = F.size(F.filter("template", lambda t: t != F.lit(WILDCARD)))
    own = distinct.where(F.col("n") >= min_docs).select("leaf", "line_hash", F.col("masked").alias("template"))
    forms = line_forms(distinct, min_docs).where(constant >= DEPTH + MIN_TAIL)
    template = (own.unionByName(forms).where(constant >= F.size("template") * MIN_CONSTANT)
                   .select("leaf", "line_hash", F.xxhash64("template").alias("template")).distinct())
    template = materialize(template, "line-templates")
    used = kept.select("leaf", "line_hash", "__id").distinct().join(template, ["leaf", "line_hash"])
    recurring = (used.select("leaf", "template", "__id").distinct().groupBy("leaf", "template")
                     .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("leaf", "template"))
    drop = materialize(template.join(recurring, ["leaf", "template"]).select("leaf", "line_hash").distinct(), "lines-to-drop")
    return kept.join(drop, ["leaf", "line_hash"]).select("__id", "__row", "line_no", "chars", "__doc")


def surely_long(docs: DataFrame) -> int:
    """Tokens from which a line of this corpus does not repeat by chance."""
    n = docs.agg(F.sum(F.size(F.split("text", "\n")).cast("long"))).first()[0] or 1
    return max(MIN_TOKENS, -(-(2 * max(n, 1).bit_length() - 1 + CHANCE_BITS) // TOKEN_BITS))


def sure_lines(docs: DataFrame, min_docs: int = MIN_DOCS, long_docs: int = LONG_DOCS) -> DataFrame:
    """(__id, __row, line_no) of every line that recurs in documents unlike each other."""
    long = F.col("size") >= surely_long(docs)
    need = F.when(long, F.lit(long_docs)).otherwise(F.lit(min_docs))
    lines = lines_of(docs).select("__id", "__row", "line_no", "line_hash", F.size("masked").alias("size"))
    often = (lines.select("line_hash", "size", "__id").distinct().groupBy("line_hash", "size").agg(F.count(F.lit(1)).alias("n"))
                  .where(F.col("n") >= need))
    often = materialize(often, "often-lines")
    held = materialize(lines.join(often, ["line_hash", "size"]), "often-held")
    # For each seed the two least hashes of a document's lines: one is not the line itself.
    # Only documents that hold such a line are read again.
    holders = materialize(held.select("__id", "__row").distinct(), "often-holders")
    line = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), lambda t: let(masked_tokens(t), lambda w: F.when(
        F.size(w) > 0, F.xxhash64(w)))), lambda h: h.isNotNull()))
    least = F.array(*[F.slice(F.array_sort(F.transform("__hashes", lambda h, k=k: F.xxhash64(h, F.lit(k)))), 1, 2) for k in range(SEEDS)])
    sketch = (docs.select("text", *_keys(docs)).join(holders, ["__id", "__row"], "left_semi")
                  .select("__id", "__row", line.alias("__hashes")).select("__id", "__row", least.alias("least")).distinct())
    sketch = materialize(sketch, "line-sketches")
    other = F.array(*[let(F.col("least")[k], lambda two, k=k: F.coalesce(F.get(F.filter(
        two, lambda h: h != F.xxhash64(F.col("line_hash"), F.lit(k))), 0), F.lit(0))) for k in range(SEEDS)])
    rest = (held.select("line_hash", "size", "n", "__id", "__row").distinct().join(sketch, ["__id", "__row"])
                .select("line_hash", "size", "n", F.posexplode(other).alias("seed", "rest")))
    differ = F.when(long, F.lit(LONG_UNLIKE)).otherwise(F.lit(min_docs))
    unlike = (rest.distinct().groupBy("line_hash", "size", "n", "seed").agg(F.count(F.lit(1)).alias("unlike"))
                  .groupBy("line_hash", "size", "n").agg(F.sort_array(F.collect_list("unlike"))[DOUBT].alias("unlike"))
                  .where((F.col("unlike") >= differ) & (F.col("unlike") * 2 >= F.col("n"))))
    sure = materialize(unlike.select("line_hash", "size"), "sure-lines")
    return held.join(sure, ["line_hash", "size"]).select("__id", "__row", "line_no")


def drop_lines(lines: Column, gone: Column) -> Column:
    """The lines without those at the sorted 0-based positions ``gone``: the runs between
    dropped positions, so linear in the document's length."""
    runs = F.transform(F.sequence(F.lit(0), F.size(gone)), lambda j: let(
        F.when(j == 0, F.lit(0)).otherwise(F.element_at(gone, F.greatest(j, F.lit(1))) + 1), lambda a: F.slice(
            lines, a + 1, F.when(j == F.size(gone), F.size(lines)).otherwise(
                F.element_at(gone, F.least(j + 1, F.size(gone)))) - a)))
    return F.array_join(F.flatten(runs), "\n")


def dropped_lines(docs: DataFrame, min_docs: int, long_docs: int | None) -> DataFrame:
    """(__id, __row, __gone): the sorted positions of the lines that go from a document."""
    def positions(rows: DataFrame, *more: Column) -> DataFrame:
        return rows.groupBy("__id", "__row").agg(F.sort_array(F.collect_set("line_no")).alias("__gone"), *more)

    rows = recurring_lines(docs, min_docs).distinct()
    gone = positions(rows, F.sum("chars").alias("lost"), F.first("__doc").alias("__doc"))
    left = F.col("__doc.lines") - F.size("__gone")
    # The lines' characters and the newlines between those that stay.
    rest = F.when(left == 0, 0).otherwise(F.col("__doc.length") - (F.col("__doc.lines") - 1) - F.col("lost") + left - 1)
    gone = materialize(gone.select("__id", "__row", "__gone", (rest * 2 < F.col("__doc.length")).alias("most"), F.col("__doc.set").alias("set")),
                       "recurring-positions")
    if long_docs is None:
        copies = (gone.where("most").select("set", "__id").distinct().groupBy("set").agg(F.count(F.lit(1)).alias("n"))
                      .where("n > 1").select("set", F.lit(True).alias("copy")))
        kept = gone.join(copies, "set", "left").where(~F.col("most") | F.col("copy").isNull())
        return materialize(kept.select("__id", "__row", "__gone"), "dropped-lines")
    sure = positions(sure_lines(docs, min_docs, long_docs)).withColumnRenamed("__gone", "__sure")
    none = F.array().cast("array<int>")
    both = gone.where(~F.col("most")).select("__id", "__row", "__gone").join(sure, ["__id", "__row"], "full")
    return materialize(both.select("__id", "__row", F.sort_array(F.array_union(
        F.coalesce("__gone", none), F.coalesce("__sure", none))).alias("__gone")), "dropped-lines")


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, report: bool = False, long_docs: int | None = None) -> DataFrame:
    """The documents without their recurring lines; with ``long_docs`` also without those
    that recur surely. With ``report``: doc_id, n_lines, n_dropped and text instead of the
    input's columns."""
    gone = dropped_lines(docs, min_docs, long_docs)
    # The input is one struct column, so its names meet none of these.
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__in"), *_keys(docs)).join(gone, ["__id", "__row"], "left")
    cut = F.col("__gone").isNotNull()
    own = F.col("__in.text")
    text = F.when(cut, let(F.split(own, "\n"), lambda ls: drop_lines(ls, F.col("__gone")))).otherwise(own)
    if report:
        return d.select(F.col("__in.doc_id").alias("doc_id"), F.coalesce(F.size(F.split(own, "\n")), F.lit(0)).cast("long").alias("n_lines"),
                        F.when(cut, F.size("__gone")).otherwise(F.lit(0)).cast("long").alias("n_dropped"), text.alias("text"))
    kind = dict(docs.dtypes)

    def column(c: str) -> Column:
        if c == "text":
            return text
        if c == "n_chars":
            return F.when(cut, F.length(text).cast(kind[c])).otherwise(F.col("__in.n_chars"))
        return F.col(f"__in.`{c}`")

    return d.select(*[column(c).alias(c) for c in docs.columns])


# The report in DuckDB SQL, stated on its own.
REPORT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(doc_id, -9223372036854775808) AS id, text FROM documents),
l0 AS (SELECT k, id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
       FROM d WHERE length(text) > 0),
l1 AS (SELECT k, id, line_no, list_transform(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''),
              lambda x: CASE WHEN regexp_matches(x, '[0-9@]|://') THEN '<*>' ELSE x END) AS m FROM l0),
ln AS (SELECT *, len(m) || ' ' || array_to_string(m[1:3], ' ') AS leaf, array_to_string(m, ' ') AS ml FROM l1 WHERE len(m) >= 4),
leaves AS (SELECT leaf FROM ln GROUP BY leaf HAVING count(DISTINCT id) >= 20),
kept AS (SELECT ln.* FROM ln JOIN leaves USING (leaf)),
dl AS (SELECT leaf, ml, any_value(m) AS m, count(DISTINCT id) AS n FROM kept GROUP BY leaf, ml),
pl AS (SELECT leaf, ml, n, unnest(m) AS tok, generate_subscripts(m, 1) AS pos FROM dl),
fr AS (SELECT leaf, pos, tok, length(bin(s // 20)) - 1 AS lvl FROM (SELECT leaf, pos, tok, sum(n)::BIGINT AS s FROM pl WHERE tok <> '<*>' GROUP BY ALL)
       WHERE s >= 20),
pv AS (SELECT pl.leaf, pl.ml, pl.pos, pl.tok, coalesce(fr.lvl, -1) AS lvl
       FROM pl LEFT JOIN fr ON fr.leaf = pl.leaf AND fr.pos = pl.pos AND fr.tok = pl.tok),
ks AS (SELECT DISTINCT leaf, ml, lvl AS k FROM pv WHERE lvl >= 0),
ge AS (SELECT pv.leaf, pv.ml, ks.k, list(CASE WHEN pv.lvl >= ks.k THEN pv.tok ELSE '<*>' END ORDER BY pv.pos) AS t
       FROM pv JOIN ks ON ks.leaf = pv.leaf AND ks.ml = pv.ml GROUP BY pv.leaf, pv.ml, ks.k),
te AS (SELECT DISTINCT leaf, ml, array_to_string(t, ' ') AS t FROM
         (SELECT leaf, ml, m AS t FROM dl WHERE n >= 20
          UNION ALL SELECT leaf, ml, t FROM ge WHERE len(list_filter(t, lambda x: x <> '<*>')) >= 5)
       WHERE len(list_filter(t, lambda x: x <> '<*>')) >= len(t) * 0.6),
rec AS (SELECT te.leaf, te.t FROM kept JOIN te USING (leaf, ml) GROUP BY te.leaf, te.t HAVING count(DISTINCT id) >= 20),
gone AS (SELECT DISTINCT kept.k, kept.line_no FROM kept JOIN te USING (leaf, ml) JOIN rec USING (leaf, t)),
rest AS (SELECT l0.k, string_agg(l0.line, chr(10) ORDER BY l0.line_no) AS new FROM l0 LEFT JOIN gone USING (k, line_no)
         WHERE gone.k IS NULL GROUP BY l0.k),
cnt AS (SELECT k, count(*) AS g FROM gone GROUP BY k),
sets AS (SELECT k, any_value(id) AS id, list_sort(list_distinct(list(ml))) AS lines FROM ln GROUP BY k),
cut AS (SELECT d.k, d.doc_id, d.text, coalesce(rest.new, '') AS new, cnt.g, 2 * length(coalesce(rest.new, '')) < length(d.text) AS most, sets.id, sets.lines
        FROM d LEFT JOIN cnt USING (k) LEFT JOIN rest USING (k) LEFT JOIN sets USING (k)),
copies AS (SELECT lines FROM cut WHERE g IS NOT NULL AND most GROUP BY lines HAVING count(DISTINCT id) > 1),
fin AS (SELECT cut.*, g IS NOT NULL AND NOT (most AND copies.lines IS NOT NULL) AS go FROM cut LEFT JOIN copies ON copies.lines = cut.lines)
SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines,
       CAST(CASE WHEN go THEN g ELSE 0 END AS BIGINT) AS n_dropped, CASE WHEN go THEN new ELSE text END AS text FROM fin
"""
