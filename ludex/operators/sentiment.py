"""Lexicon- and rule-based review sentiment (H1) and its three-way class (H2).

The compound score follows the rule-based method of Hutto & Gilbert, "VADER: A
Parsimonious Rule-based Model for Sentiment Analysis of Social Media Text" (ICWSM 2014).
Two *input tables* drive it: the valence word list ``(token, valence)``, which the source
project downloads at run time and does not ship, the modifiers ``(token, kind, step)``
(kind ``negation`` or ``booster``) and the phrases ``(phrase, kind, value)`` (kind ``idiom``,
``booster`` or ``neutral``), both by default the published lists below.

Tokens are split at white space; outer ASCII punctuation is stripped unless two characters
or fewer would be left (so ``:)`` stays a token). Every script is kept.

Phrases come first: from left to right the longest phrase that starts at a token becomes one
token (phrases don't overlap). An idiom is then a word with its own valence, "kind of" a
booster, and "without doubt" a word that negates nothing. Distances count a phrase as one.

Rules, in the published order, for each lexicon word:
  * "no" before it (directly, at two tokens, or at three with "or" / "nor" between) turns its
    valence by the negative scalar; a "no" directly before a lexicon word has no valence;
  * a word in capitals, in a text that also has others, gains a fixed step;
  * for each of the three tokens before it that is not itself a lexicon word: a booster
    adds its step away from zero (damped by distance; more if it is in capitals in a mixed
    text), then a negation (listed, or containing ``n't``) multiplies by a negative
    scalar, each on its own; ``never so`` / ``never this`` intensifies instead;
  * ``least`` directly before negates, unless after ``at`` or ``very``;
  * contrast: with "but" in the text, words before it weigh half, words after it 1.5;
  * "!" (up to four) and "?" (more than one) push the sum away from zero;
  * normalisation ``s / sqrt(s^2 + alpha)``, clipped to [-1, 1].
An emoji scores where the lexicon lists it as a token. Numeric equality with the original
library cannot be checked here (it is not installed).

Plan: a Bloom filter of the vocabulary (``BloomFilter``, a few kilobytes in the plan) is
tested inside the row, so only tokens that can score are exploded, with their neighbours
(from the token array inside the row: no window, no self-join); these meet the lexicon, and
only the hits look their neighbours up. Phrases are a trie over token hashes, one table row
an edge: rows leave a text only where its first two tokens pass the phrases' filter, and walk
the trie edge by edge. The phrases found meet the texts by key before these are split; a text
is stripped and lower-cased whole, and phrases are merged run by run, so a row's cost is linear
in its length. The vocabulary is written first: which side is broadcast is left to the planner,
by size. Sums are pre-aggregated map-side and meet the per-document counts by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ludex.session import materialize

# ---------------------------------------------------------------------------
# Fixed values from the published method.
ALPHA = 15.0                 # normalisation constant
NEGATION_SCALAR = -0.74      # multiplier when a negation precedes the word
CAPS_STEP = 0.733            # emphasis of an all-caps word in a text that is not all caps
BOOSTER_STEP = 0.293         # booster increment / decrement
BOOSTER_DAMPING = (1.0, 0.95, 0.9)  # by distance 1, 2, 3 tokens before the word
NEVER_STEP = (None, 1.5, 1.25)      # "never so / this" by distance of "never"
BUT_BEFORE, BUT_AFTER = 0.5, 1.5
EXCLAMATION_STEP, EXCLAMATION_MAX = 0.292, 4
QUESTION_STEP, QUESTION_MAX_COUNT, QUESTION_CAP = 0.18, 3, 0.96
POSITIVE_AT, NEGATIVE_AT = 0.05, -0.05  # class thresholds (inclusive)
CONTRAST_WORD = "but"
# Negation words (those with n't are found by that).
NEGATIONS = (
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "dont",
    "hadnt", "hasnt", "havent", "isnt", "mightnt", "mustnt", "neither", "neednt", "never",
    "none", "nope", "nor", "not", "nothing", "nowhere", "oughtnt", "shant", "shouldnt",
    "uhuh", "wasnt", "werent", "without", "wont", "wouldnt", "rarely", "seldom", "despite",
)
# Single-word boosters that raise intensity.
BOOSTERS_UP = (
    "absolutely", "amazingly", "awfully", "completely", "considerably", "decidedly",
    "deeply", "effing", "enormously", "entirely", "especially", "exceptionally",
    "extremely", "fabulously", "flipping", "flippin", "fricking", "frickin", "frigging",
    "friggin", "fully", "fucking", "greatly", "hella", "highly", "hugely", "incredibly",
    "intensely", "majorly", "more", "most", "particularly", "purely", "quite", "really",
    "remarkably", "so", "substantially", "thoroughly", "totally", "tremendously", "uber",
    "unbelievably", "unusually", "utterly", "very",
)
# Single-word boosters that lower intensity.
BOOSTERS_DOWN = (
    "almost", "barely", "hardly", "kinda", "kindof", "kind-of", "less", "little",
    "marginally", "occasionally", "partly", "scarcely", "slightly", "somewhat", "sorta",
    "sortof", "sort-of",
)
# Idioms and their valence, boosters of several words, phrases with a negation that negate
# nothing.
IDIOMS = {"the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "bus stop": 0.0, "yeah right": -2.0, "kiss of death": -1.5,
          "to die for": 3.0, "beating heart": 3.1, "broken heart": -2.9, "cut the mustard": 2.0, "hand to mouth": -2.0}
BOOSTER_PHRASES = ("kind of", "sort of", "just enough")
NEUTRAL_PHRASES = ("without doubt", "without a doubt")
# Words between a "no" three tokens before and the word that it negates.
NO_WORD, NO_LINKS = "no", ("or", "nor")
# ---------------------------------------------------------------------------

MAX_FILTER_BITS = 1 << 20        # a filter has 16 bits a word, up to this many in all
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MODIFIERS = "token string, kind string, step double"
PHRASES = "phrase string, kind string, value double"


def default_modifiers(spark: SparkSession) -> DataFrame:
    """The published negation and booster lists as a ``(token, kind, step)`` table."""
    rows = ([(t, "negation", None) for t in NEGATIONS] + [(t, "booster", BOOSTER_STEP) for t in BOOSTERS_UP]
            + [(t, "booster", -BOOSTER_STEP) for t in BOOSTERS_DOWN])
    return spark.createDataFrame(rows, MODIFIERS)


def default_phrases(spark: SparkSession) -> DataFrame:
    """The published phrases as a ``(phrase, kind, value)`` table."""
    rows = ([(t, "idiom", v) for t, v in IDIOMS.items()] + [(t, "booster", -BOOSTER_STEP) for t in BOOSTER_PHRASES]
            + [(t, "neutral", None) for t in NEUTRAL_PHRASES])
    return spark.createDataFrame(rows, PHRASES)


class BloomFilter:
    """Two bits per key of a table, as an array literal: ``test(hash)`` is true for every key
    and for few others. Only bit positions are collected, at most ``MAX_FILTER_BITS``."""

    def __init__(self, keys: DataFrame, column: str, size: int | None = None):
        n = keys.count() if size is None else size
        bits = 64
        while bits < min(16 * n, MAX_FILTER_BITS):
            bits *= 2
        self.mask = bits - 1
        words = [0] * (bits // 64)
        places = keys.select(F.explode(F.array(*self._places(F.col(column)))).alias("p")).distinct()
        for (p,) in places.collect():
            words[p >> 6] |= 1 << (p & 63)
        signed = (w - (1 << 64) if w >> 63 else w for w in words)
        self.words = F.expr("array(" + ", ".join("(-9223372036854775807L - 1L)" if w == -(1 << 63) else f"{w}L" for w in signed) + ")")

    def _places(self, h: Column) -> list[Column]:
        return [x.bitwiseAND(F.lit(self.mask)) for x in (h, F.shiftrightunsigned(h, 32))]

    def test(self, h: Column) -> Column:
        one = lambda p: F.call_function("shiftright", F.get(self.words, F.shiftright(p, 6).cast("int")), p.cast("int")).bitwiseAND(F.lit(1)) == 1
        a, b = self._places(h)
        return one(a) & one(b)

    def passing(self, hashes: Column) -> Column:
        """Positions (from 0) of an array's hashes that pass, each hash computed once."""
        return F.filter(F.transform(hashes, lambda h, i: F.when(self.test(h), i)), lambda i: i.isNotNull())


def phrase_trie(phrases: DataFrame) -> tuple[DataFrame, int]:
    """Edges ``(parent, token, child, ends)`` over hashes of the phrases' token prefixes, and
    the most tokens of a phrase; ``ends`` where a phrase ends at the child. Phrases of one
    word are for the lexicon and the modifiers."""
    toks = F.filter(F.split(F.lower("phrase"), "\\s+"), lambda t: t != "")
    p = phrases.select(toks.alias("t")).where(F.size("t") > 1).distinct()
    at = F.transform(F.sequence(F.lit(1), F.size("t")), lambda i: F.struct(
        F.xxhash64(F.slice("t", 1, i - 1)).alias("parent"), F.element_at("t", i).alias("token"),
        F.xxhash64(F.slice("t", 1, i)).alias("child"), (i == F.size("t")).alias("ends"), i.alias("depth")))
    edges = p.select(F.explode(at).alias("e")).select("e.*").groupBy("parent", "token", "child", "depth").agg(F.max("ends").alias("ends"))
    return edges, p.agg(F.coalesce(F.max(F.size("t")), F.lit(0))).first()[0]


def phrase_places(docs: DataFrame, key: str, text_col: str, phrases: DataFrame) -> DataFrame | None:
    """``_k`` and the phrases of its text, ``_m``: where each starts and its tokens, at each place
    the longest one, from left to right, without overlap. Only places whose first two tokens pass
    the phrases' filter leave the row; their next tokens walk the trie, one join a depth."""
    edges, longest = phrase_trie(phrases)
    if longest < 2:
        return None
    edges = materialize(edges, "phrase-trie")
    starts = BloomFilter(edges.where("depth = 2"), "child")
    toks = F.col("_toks")
    pair = starts.passing(F.transform(toks, lambda t, i: F.xxhash64(t, F.get(toks, i + 1))))
    places = F.transform(pair, lambda i: F.struct((i + 1).alias("_at"), F.slice(toks, i + 1, longest).alias("_w")))
    lowered = docs.select(F.col(key).alias("_k"), tokens(F.lower(bare_text(F.col(text_col)))).alias("_toks"))
    walk = lowered.select("_k", F.explode(places).alias("_p")).select("_k", "_p.*").withColumn("_n", F.lit(None).cast("int"))
    for depth in range(2, longest + 1):
        step = edges.where(F.col("depth") == depth).select(F.col("child").alias("_child"), F.col("ends").alias("_ends"))
        here = F.when(F.size("_w") >= depth, F.xxhash64(F.slice("_w", 1, depth))) == F.col("_child")
        walk = walk.join(step, here, "inner" if depth == 2 else "left").withColumn(
            "_n", F.when(F.col("_ends"), F.lit(depth)).otherwise(F.col("_n"))).drop("_child", "_ends")
    # A key that stands in several rows has each place once.
    found = walk.where(F.col("_n").isNotNull()).groupBy("_k", "_at").agg(F.max("_n").alias("_n")).groupBy("_k").agg(
        F.sort_array(F.collect_list(F.struct("_at", "_n"))).alias("_m"))
    none = F.array().cast("array<struct<_at:int,_n:int>>")
    free = lambda kept, m: F.element_at(kept, -1)["_at"] + F.element_at(kept, -1)["_n"] <= m["_at"]
    chosen = F.aggregate("_m", none, lambda kept, m: F.when((F.size(kept) == 0) | free(kept, m), F.concat(kept, F.array(m))).otherwise(kept))
    apart = F.forall(F.sequence(F.lit(1), F.size("_m")), lambda j: (j == 1) | (
        F.get("_m", F.greatest(j - 2, F.lit(0)))["_at"] + F.get("_m", F.greatest(j - 2, F.lit(0)))["_n"] <= F.get("_m", j - 1)["_at"]))
    return found.select("_k", F.when(apart, F.col("_m")).otherwise(chosen).alias("_m"))


def merged_tokens(c: str) -> Column:
    """The tokens ``c`` with every phrase of ``_m`` as one token: the runs between phrases, and
    the phrases, so linear in the text's length."""
    m = lambda j: F.get("_m", j)
    after = lambda j: F.when(j == 0, F.lit(1)).otherwise(m(F.greatest(j - 1, F.lit(0)))["_at"] + m(F.greatest(j - 1, F.lit(0)))["_n"])
    runs = F.transform(F.sequence(F.lit(0), F.size("_m")), lambda j: F.when(
        j == F.size("_m"), F.slice(F.col(c), after(j), F.size(c))).otherwise(F.concat(
            F.slice(F.col(c), after(j), F.greatest(m(j)["_at"] - after(j), F.lit(0))),
            F.array(F.array_join(F.slice(F.col(c), m(j)["_at"], m(j)["_n"]), " ")))))
    return F.when(F.col("_m").isNull(), F.col(c)).otherwise(F.flatten(runs))


def bare_text(text: Column) -> Column:
    """The text with each token's outer punctuation stripped, unless two characters or fewer
    would be left: what leads a token goes, then in the reversed text what ends it."""
    sign = "".join("\\" + c for c in PUNCTUATION)
    leading = f"[{sign}](?<!\\S.)[{sign}]*+(?=[^\\s{sign}]\\S+[^\\s{sign}])"
    return F.reverse(F.regexp_replace(F.reverse(F.regexp_replace(text, leading, "")), leading, ""))


def tokens(text: Column) -> Column:
    """White-space runs apart."""
    return F.array_remove(F.split(text, "\\s+"), "")


def vocabulary(lexicon: DataFrame, modifiers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(_t, _v)`` of the lexicon, and ``(_t, _lex, _neg, _step)`` of every listed word;
    lower-cased, one row per word."""
    lex = (lexicon.select(F.lower("token").alias("_t"), F.col("valence").cast("double").alias("_v"))
                  .where(F.col("_t").isNotNull()).groupBy("_t").agg(F.max("_v").alias("_v")))
    mod = modifiers.select(F.lower("token").alias("_t"), F.lit(False).alias("_lex"), (F.col("kind") == "negation").alias("_neg"),
                           F.when(F.col("kind") == "booster", F.col("step").cast("double")).alias("_step"))
    both = mod.unionByName(lex.select("_t", F.lit(True).alias("_lex"), F.lit(False).alias("_neg"),
                                      F.lit(None).cast("double").alias("_step")))
    words = both.where(F.col("_t").isNotNull()).groupBy("_t").agg(
        F.max("_lex").alias("_lex"), F.max("_neg").alias("_neg"), F.max("_step").alias("_step"))
    return lex, words


def _documents(docs: DataFrame, key: str, text_col: str, places: DataFrame | None) -> DataFrame:
    """Key, whether capitals and other words mix, and the tokens as written (``_raw``) and
    lower-cased (``_toks``), phrases as one token. The texts meet their phrases before they are
    split, so that no token list is shuffled."""
    d = docs.select(F.col(key), bare_text(F.col(text_col)).alias("_bare"))
    if places is not None:
        d = docs.select(F.col(key), F.col(text_col).alias("_text")).join(places, F.col(key) == F.col("_k"), "left").select(
            key, "_m", bare_text(F.col("_text")).alias("_bare"))
    bare = F.col("_bare")
    d = d.withColumns({"_raw": tokens(bare), "_toks": tokens(F.lower(bare))})
    d = d.withColumn("_ncaps", F.size(F.filter("_raw", is_caps)))
    d = d.withColumn("_mixed", (F.col("_ncaps") > 0) & (F.col("_ncaps") < F.size("_raw")))
    if places is not None:
        d = d.withColumns({"_raw": merged_tokens("_raw"), "_toks": merged_tokens("_toks")})
    return d.select(key, "_mixed", "_raw", "_toks")


def is_caps(t: Column) -> Column:
    """Written in capitals (with at least one letter that has a small form)."""
    return (t == F.upper(t)) & (t != F.lower(t))


def _scored(hits: DataFrame) -> DataFrame:
    """Lexicon words with their score ``_s``, from their own columns and those of their
    predecessors: each one's booster step and factor, then one fold over the three."""
    mixed = F.col("_mixed")
    so_this = lambda k: F.coalesce(F.col(f"_p{k}").isin("so", "this"), F.lit(False))
    rules = []
    for k in (1, 2, 3):
        p = F.col(f"_p{k}")
        counts = p.isNotNull() & ~F.coalesce(F.col(f"_lex{k}"), F.lit(False))
        step = F.col(f"_step{k}") + F.when(F.col(f"_cap{k}") & mixed, F.lit(CAPS_STEP)).otherwise(F.lit(0.0))
        negates = F.coalesce(F.col(f"_neg{k}"), F.lit(False)) | F.coalesce(p.contains("n't"), F.lit(False))
        factor = F.when(counts & negates, F.lit(NEGATION_SCALAR)).otherwise(F.lit(1.0))
        if k > 1:
            near = so_this(1) if k == 2 else (so_this(1) | so_this(2))
            factor = F.when(counts & (p == "never") & near, F.lit(NEVER_STEP[k - 1])).otherwise(factor)
        rules.append(F.struct(F.coalesce(F.when(counts, step * BOOSTER_DAMPING[k - 1]), F.lit(0.0)).alias("b"), factor.alias("f")))
    least = (F.col("_p1") == "least") & ~F.coalesce(F.col("_lex1"), F.lit(False)) \
        & ~F.coalesce(F.col("_p2").isin("at", "very"), F.lit(False))
    rules.append(F.struct(F.lit(0.0).alias("b"), F.when(F.coalesce(least, F.lit(False)), F.lit(NEGATION_SCALAR)).otherwise(F.lit(1.0)).alias("f")))
    i, b = F.col("_i") + 1, F.col("_but")
    weight = F.when(b == 0, F.lit(1.0)).when(i < b, F.lit(BUT_BEFORE)).when(i > b, F.lit(BUT_AFTER)).otherwise(F.lit(1.0))
    no = lambda k: F.coalesce(F.col(f"_p{k}") == NO_WORD, F.lit(False))
    turned = no(1) | no(2) | (no(3) & F.coalesce(F.col("_p1").isin(*NO_LINKS), F.lit(False)))
    silent = (F.col("_toks") == NO_WORD) & F.coalesce(F.col("_lex_next"), F.lit(False))
    own = F.when(turned, F.col("_v") * NEGATION_SCALAR).when(silent, F.lit(0.0)).otherwise(F.col("_v"))
    start = own + F.when(F.col("_cap") & mixed, F.signum(own) * CAPS_STEP).otherwise(F.lit(0.0))
    score = F.aggregate(F.array(*rules), start, lambda s, r: (s + F.when(s < 0, -r["b"]).otherwise(r["b"])) * r["f"])
    return hits.withColumn("_s", score * weight)


def compound_scores(docs: DataFrame, key: str, text_col: str, lexicon: DataFrame,
                    modifiers: DataFrame | None = None, phrases: DataFrame | None = None) -> DataFrame:
    """``key, compound`` for every row of ``docs`` (``key`` must identify a text):
    polarity in [-1, 1], 0 when no lexicon word occurs, null for a null text."""
    spark = docs.sparkSession
    phrases = phrases if phrases is not None else default_phrases(spark)
    modifiers = modifiers if modifiers is not None else default_modifiers(spark)
    several = phrases.where(F.col("phrase").isNotNull()).select(F.array_join(F.filter(F.split(F.lower("phrase"), "\\s+"), lambda t: t != ""), " ").alias("token"),
                                                                 "kind", F.col("value").cast("double").alias("value"))
    lexicon = lexicon.select("token", F.col("valence").cast("double").alias("valence")).unionByName(
        several.where("kind = 'idiom'").select("token", F.col("value").alias("valence")))
    modifiers = modifiers.select("token", "kind", F.col("step").cast("double").alias("step")).unionByName(
        several.where("kind = 'booster'").select("token", "kind", F.col("value").alias("step")))
    # Written, so that the planner knows their sizes: hits are shuffled only for large ones.
    lex, words = (materialize(t, n) for t, n in zip(vocabulary(lexicon, modifiers), ("lexicon", "words"), strict=True))
    possible = BloomFilter(lex.select(F.xxhash64("_t").alias("h")), "h")
    d = _documents(docs, key, text_col, phrase_places(docs, key, text_col, phrases))
    d = d.withColumn("_but", F.array_position("_toks", CONTRAST_WORD))
    # Only tokens that the filter lets pass leave the row, with their neighbours.
    toks, raw = F.col("_toks"), F.col("_raw")
    at = possible.passing(F.transform(toks, lambda t: F.xxhash64(t)))
    before = lambda i, k: F.when(i >= k, F.get(raw, F.greatest(i - k, F.lit(0))))
    hit = F.transform(at, lambda i: F.struct(i.alias("_i"), F.get(toks, i).alias("_toks"), F.get(raw, i).alias("_raw"), F.get(toks, i + 1).alias("_next"),
                                             *[before(i, k).alias(f"_r{k}") for k in (1, 2, 3)]))
    found = d.select(key, "_but", "_mixed", F.explode(hit).alias("_w"))
    hits = (found.select(key, "_but", "_mixed", "_w.*").join(lex, F.col("_toks") == F.col("_t")).drop("_t")
                  .withColumn("_cap", is_caps(F.col("_raw"))))
    for k in (1, 2, 3):
        hits = hits.withColumn(f"_p{k}", F.lower(f"_r{k}")).withColumn(f"_cap{k}", is_caps(F.col(f"_r{k}")))
        own = words.select(*[F.col(c).alias(f"{c}{k}") for c in ("_t", "_lex", "_neg", "_step")])
        hits = hits.join(own, F.col(f"_p{k}") == F.col(f"_t{k}"), "left")
    following = words.where("_lex").select(F.col("_t").alias("_t_next"), F.col("_lex").alias("_lex_next"))
    hits = hits.join(following, F.col("_next") == F.col("_t_next"), "left")
    sums = _scored(hits).groupBy(F.col(key).alias("_k")).agg(F.sum("_s").alias("_sum"))
    text = F.col(text_col)
    signs = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    j = docs.select(F.col(key), text.isNull().alias("_null"), signs("!").alias("_bangs"), signs("?").alias("_quests")).join(sums, F.col(key) == F.col("_k"), "left")
    tot, bangs, quests = F.coalesce("_sum", F.lit(0.0)), F.col("_bangs"), F.col("_quests")
    amp = (F.least(bangs, F.lit(EXCLAMATION_MAX)) * F.lit(EXCLAMATION_STEP)
           + F.when(quests <= 1, F.lit(0.0))
              .when(quests <= QUESTION_MAX_COUNT, quests * F.lit(QUESTION_STEP))
              .otherwise(F.lit(QUESTION_CAP)))
    s = F.when(tot > 0, tot + amp).when(tot < 0, tot - amp).otherwise(tot)
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s / F.sqrt(s * s + F.lit(ALPHA))))
    return j.select(key, F.when(F.col("_null"), F.lit(None).cast("double")).otherwise(c).alias("compound"))


def sentiment_class(score: Column) -> Column:
    """2 positive (>= 0.05), 0 negative (<= -0.05), 1 otherwise, null text -> 1."""
    return (F.when(score >= POSITIVE_AT, F.lit(2))
             .when(score <= NEGATIVE_AT, F.lit(0))
             .otherwise(F.lit(1))).cast("int")


def score_texts(df: DataFrame, lexicon: DataFrame, key: str = "doc_id", text_col: str = "text",
                modifiers: DataFrame | None = None, phrases: DataFrame | None = None) -> DataFrame:
    """``key, compound, sentiment`` for a table whose ``key`` identifies each text."""
    scores = compound_scores(df, key, text_col, lexicon, modifiers, phrases)
    return scores.withColumn("sentiment", sentiment_class(F.col("compound")))


def classify_rows(df: DataFrame, text_col: str, lexicon: DataFrame, out: str = "sentiment",
                  modifiers: DataFrame | None = None, phrases: DataFrame | None = None) -> DataFrame:
    """Replace the text column by a sentiment class, for a table without a text key
    (e.g. reviews).

    A text's score depends on the text alone, so distinct texts are scored once — keyed
    by two independent 64/32-bit hashes and the length (no practical collision), with
    map-side de-duplication before the shuffle — and joined back to the rows. The texts are
    written, as scoring reads them several times, and the scores are read from a written table: the join's inputs are then plain shuffles, which
    adaptive execution splits where one text holds many rows."""
    key = F.concat_ws(":", F.xxhash64(F.col(text_col)).cast("string"), F.hash(F.col(text_col)).cast("string"),
                      F.length(F.col(text_col)).cast("string"))
    keyed = df.withColumn("_rk", key)
    # (key, text) pairs are distinct exactly when texts are; grouping on both keeps the
    # de-duplication a hash aggregate.
    texts = materialize(keyed.where(F.col(text_col).isNotNull()).select("_rk", text_col).distinct(), "distinct-texts")
    scores = materialize(compound_scores(texts, "_rk", text_col, lexicon, modifiers, phrases), "text-scores")
    return (keyed.drop(text_col).join(scores, "_rk", "left")
                 .withColumn(out, sentiment_class(F.col("compound")))
                 .drop("_rk", "compound"))
