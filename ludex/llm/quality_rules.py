"""Line-first quality rules over whole texts, as DataFrame expressions only.

Every line is judged on its own: a line fails if symbols and doubled exclamation marks
are too many for its words (punctuation), if it is a row of short separated entries
(navigation), if it is a known notice (boilerplate), or if it says few words again and
again (repetition). Failing lines are removed; a document that loses too much of its text,
or fails the base counts, is rejected.

Words are ``[^\\x20\\x09-\\x0D]+``. Repeated three-word windows are found by sorting the
document's 64-bit window hashes with their positions: n log n in the document's length,
no shuffle. All work is per row in one narrow pass, so no key can be hot.

Edge cases: null or empty text has no word, so it fails the base rule and is rejected;
equal rows give equal rows; a null doc_id stays null; no other column is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 30
MARKS_PER_10_WORDS = 3      # symbols and doubled exclamation marks a line may have
BARS_PER_10_WORDS = 2       # separators of a navigation line
REPETITION_WORDS = 10       # lines from this length on are tested for repetition

SPACE = "[\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
# Openings and phrases of notices that are not prose.
BOILERPLATE = ("licensed under|released under the|all rights reserved|terms of (use|service)|privacy policy|"
               "cookie policy|accept (all )?cookies|subscribe to our|sign up for our|click here to|"
               "powered by wordpress|javascript is disabled|copyright \\(c\\)")


def let(value: Column, body) -> Column:
    """``body`` applied to a value computed once (a lambda variable is not re-evaluated)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != F.lit(""))


def count_words(text: Column) -> Column:
    return F.size(words(text))


def repeated_window_words(w: Column) -> Column:
    """Words lying in a three-word window that occurs at least twice."""
    def covered(s: Column) -> Column:
        n = F.size(s)
        same = lambda i, j: F.element_at(s, i + 1)["h"] == F.element_at(s, j + 1)["h"]
        twin = F.transform(s, lambda x, i: F.when(
            F.when(i > 0, same(i - 1, i)).otherwise(F.lit(False))
            | F.when(i < n - 1, same(i, i + 1)).otherwise(F.lit(False)), x["p"]))
        return let(F.sort_array(F.filter(twin, lambda p: p.isNotNull())), lambda r: F.aggregate(
            F.transform(r, lambda p, i: F.when(i == F.size(r) - 1, F.lit(3))
                        .otherwise(F.least(F.lit(3), F.element_at(r, F.least(i + 2, F.size(r))) - p))),
            F.lit(0).cast("long"), lambda a, b: a + b))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(
        F.xxhash64(F.element_at(w, i + 1), F.element_at(w, i + 2), F.element_at(w, i + 3)).alias("h"), i.alias("p")))
    return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(F.sort_array(windows), covered))


def line_fails(line: Column, n_words: Column, n_distinct: Column) -> Column:
    """Whether a line is removed (a line without words never is)."""
    marks = F.regexp_count(line, F.lit(SYMBOLS)) + F.regexp_count(line, F.lit("!!"))
    bars = F.regexp_count(line, F.lit("[|»>•·]"))
    return (n_words > 0) & (
        (marks * 10 > n_words * MARKS_PER_10_WORDS)
        | ((bars >= 3) & (bars * 10 > n_words * BARS_PER_10_WORDS))
        | F.lower(line).rlike(BOILERPLATE)
        | ((n_words >= REPETITION_WORDS) & (n_distinct * 10 < n_words * 3)))


def judge_lines(text: Column) -> Column:
    """array<struct<n int, bad boolean, line string>> of the text's lines with a word."""
    lines = F.transform(F.split(text, "\n"), lambda s: let(words(s), lambda w: F.struct(
        F.size(w).alias("n"), line_fails(s, F.size(w), F.size(F.array_distinct(w))).alias("bad"), s.alias("line"))))
    return F.filter(lines, lambda x: x["n"] > 0)


def quality(docs: DataFrame) -> DataFrame:
    """Base counts, verdict and cleaned text of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id"), text.alias("text"))
    # Line numbers are not needed: what a document loses is summed, and the cleaned text
    # keeps the order of the lines.
    facts = let(judge_lines(F.col("text")), lambda ls: F.struct(
        F.aggregate(ls, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_words"),
        (F.size(ls) - F.size(F.array_distinct(F.transform(ls, lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(ls, lambda x: x["bad"])).cast("long").alias("n_bad_lines"),
        F.aggregate(F.filter(ls, lambda x: x["bad"]), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("lost_words"),
        F.array_join(F.transform(F.filter(ls, lambda x: ~x["bad"]), lambda x: x["line"]), "\n").alias("cleaned")))
    d = d.select(
        "doc_id", facts.alias("f"),
        (F.length("text") - F.regexp_count("text", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(words(F.col("text")), repeated_window_words).alias("n_repeat_words"))
    d = d.select("doc_id", "f.n_words", "word_chars", "n_symbols", "f.n_dup_lines", "n_repeat_words",
                 "f.n_bad_lines", "f.lost_words", "f.cleaned")
    base_failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    d = d.withColumn("base_failed", base_failed)
    return d.withColumn("kept", ~F.col("base_failed")
                        & (F.col("lost_words") * 100 <= F.col("n_words") * MAX_LOST_PERCENT))


def verdicts(docs: DataFrame) -> DataFrame:
    """The per-document digest, without texts."""
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                "base_failed", "kept", "n_bad_lines", "lost_words")


# The same in DuckDB SQL, stated on its own.
VERDICTS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS k FROM documents),
w AS (SELECT k, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
win AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT k, count(DISTINCT p) AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY k),
ln AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT k, line, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM ln),
lj AS (SELECT k, line, len(ws) AS n, len(list_distinct(ws)) AS u,
              length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g'))
              + (length(line) - length(replace(line, '!!', ''))) // 2 AS marks,
              length(line) - length(regexp_replace(line, '[|»>•·]', '', 'g')) AS bars
       FROM lw WHERE len(ws) > 0),
lb AS (SELECT k, line, n,
              marks * 10 > n * 3 OR (bars >= 3 AND bars * 10 > n * 2) OR (n >= 10 AND u * 10 < n * 3)
              OR regexp_matches(lower(line), 'licensed under|released under the|all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies|subscribe to our|sign up for our|click here to|powered by wordpress|javascript is disabled|copyright \(c\)') AS bad
       FROM lj),
la AS (SELECT k, count(*) - count(DISTINCT line) AS n_dup_lines, count_if(bad) AS n_bad_lines,
              coalesce(sum(n) FILTER (WHERE bad), 0) AS lost_words FROM lb GROUP BY k),
f AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(n_bad_lines, 0) AS BIGINT) AS n_bad_lines, CAST(coalesce(lost_words, 0) AS BIGINT) AS lost_words
      FROM w LEFT JOIN cov USING (k) LEFT JOIN la USING (k))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_words <= 30 * n_words AS kept
FROM f
"""
