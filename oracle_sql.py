"""Independent DuckDB SQL for every registered query.

Written as plain SQL over the raw test tables (``part``, ``lineitem``, ``orders``,
``events``, ``documents``): the bindings of FIXTURES.md §2 are inlined as CTEs and the
cleaning, profiling, sentiment, recommender and question logic is re-stated in SQL.
Column names and types follow the Spark queries in ``ludex.plans.catalog``.
"""

from __future__ import annotations

from ludex.plans import catalog as C

# Date spellings of the bindings, as formats; weekday, ordinal ending, clock and final stop are cut off first.
_DATE_FORMATS = ["%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%Y%m%d", "%Y-%m", "%Y", "%B %Y", "%b %Y", "%B %d, %Y", "%b %d, %Y",
                 "%B %d %Y", "%b %d %Y", "%d %B %Y", "%d %b %Y", "%d %B, %Y", "%d %b, %Y", "%m/%d/%Y", "%b-%d-%Y", "%d-%b-%Y", "%Y %b %d"]


def _parse_date(expr: str) -> str:
    """The first format that reads the text."""
    x = f"trim({expr})"
    x = f"regexp_replace({x}, '^(monday|tuesday|wednesday|thursday|friday|saturday|sunday|mon|tue|wed|thu|fri|sat|sun)[.,]? ', '', 'i')"
    x = f"regexp_replace({x}, '(t[0-9:]+[+][0-9:]+| [0-9]+:[0-9]+ [ap]m|[.])$', '', 'i')"
    x = f"regexp_replace({x}, '([0-9])(st|nd|rd|th)\\b', '\\1', 'i')"
    formats = ", ".join(f"'{f}'" for f in _DATE_FORMATS)
    d = f"CAST(try_strptime({x}, [{formats}]) AS DATE)"
    return f"(CASE WHEN {d} BETWEEN DATE '1677-09-22' AND DATE '2262-04-11' THEN {d} END)"


_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _number(expr: str) -> str:
    return f"(CASE WHEN regexp_matches({expr}, '{_NUMBER}') THEN TRY_CAST(trim({expr}) AS DOUBLE) END)"


def _price(expr: str) -> str:
    low = f"lower({expr})"
    return (f"CASE WHEN regexp_matches({expr}, '{_NUMBER}') THEN {_number(expr)} "
            f"WHEN {low} LIKE '%free%' THEN 0.0::DOUBLE WHEN {low} LIKE '%install%' THEN 0.0::DOUBLE "
            f"WHEN {low} LIKE '%play%' THEN 0.0::DOUBLE WHEN {low} LIKE '%third%' THEN 0.0::DOUBLE "
            f"WHEN {low} LIKE '%449%' THEN 449.0::DOUBLE WHEN {low} LIKE '%499%' THEN 499.0::DOUBLE END")


def _pct_label(ratio: str) -> str:
    return f"(CAST(round_even(({ratio}) * 100.0::DOUBLE * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS VARCHAR) || '%')"


_POSTED = ("('Posted ' || CASE WHEN l_linenumber = 7 THEN strftime(l_shipdate, '%B %-d') "
           "ELSE strftime(l_shipdate, '%B %-d, %Y') END || '.')")
_STRIPPED = f"replace({_POSTED}, 'Posted ', '')"

_GAMES_RAW = """
games_raw AS (
  SELECT p_partkey AS id,
         p_name || ' ' || CAST(p_partkey AS VARCHAR) AS app_name,
         CASE WHEN p_size % 10 = 9 THEN NULL ELSE p_brand END AS developer,
         p_type AS publisher,
         CASE WHEN p_size % 7 = 0 THEN NULL ELSE string_split(p_name, ' ') END AS genres,
         CASE p_size % 10 WHEN 0 THEN NULL WHEN 1 THEN 'Install Now' WHEN 2 THEN 'Third-party'
              WHEN 3 THEN 'Starting at $499.00' WHEN 4 THEN 'Starting at $449.00'
              WHEN 5 THEN 'Free To Play' ELSE CAST(p_retailprice AS VARCHAR) END AS price,
         CASE p_partkey % 6 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%b %Y')
              WHEN 2 THEN strftime(d, '%Y') WHEN 3 THEN 'Soon..' WHEN 4 THEN NULL
              ELSE strftime(d, '%B %-d, %Y') END AS release_date
  FROM (SELECT *, DATE '1995-01-01' + CAST(p_partkey AS INTEGER) AS d FROM part) p
),
"""

# The catalogue of the cleaning queries: more of what raw files hold.
_GAMES_EDGE = """
games_raw AS (
  SELECT CASE WHEN p_partkey % 1000 = 998 OR p_partkey % 500 = 499 THEN NULL ELSE p_partkey END AS id,
         CASE WHEN p_partkey % 1000 = 998 THEN NULL ELSE p_name || ' ' || CAST(p_partkey AS VARCHAR) END AS app_name,
         CASE WHEN p_partkey % 1000 = 998 OR p_size % 10 = 9 THEN NULL ELSE p_brand END AS developer,
         CASE WHEN p_partkey % 1000 = 998 THEN NULL ELSE p_type END AS publisher,
         CASE WHEN p_partkey % 1000 = 998 OR p_size % 7 = 0 THEN NULL ELSE string_split(p_name, ' ') END AS genres,
         CASE WHEN p_partkey % 1000 = 998 THEN NULL ELSE
         CASE p_size % 10 WHEN 0 THEN NULL WHEN 1 THEN 'Install Now' WHEN 2 THEN 'Third-party'
              WHEN 3 THEN 'Starting at $499.00' WHEN 4 THEN 'Starting at $449.00'
              WHEN 5 THEN 'Free To Play' WHEN 6 THEN
                CASE p_partkey % 4 WHEN 0 THEN '-1.5' WHEN 1 THEN '1E3' WHEN 2 THEN '1d' ELSE ' 2.5' END
              ELSE CAST(p_retailprice AS VARCHAR) END END AS price,
         CASE WHEN p_partkey % 1000 = 998 THEN NULL ELSE
         CASE p_partkey % 24 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%b %Y') WHEN 2 THEN strftime(d, '%Y')
              WHEN 3 THEN 'Soon..' WHEN 4 THEN NULL WHEN 5 THEN strftime(d, '%B %-d, %Y') WHEN 6 THEN strftime(d, '%-d %b %Y')
              WHEN 7 THEN strftime(d, '%B %Y') WHEN 8 THEN strftime(d, '%a, %-d %b %Y') WHEN 9 THEN strftime(d, '%-m/%-d/%Y')
              WHEN 10 THEN strftime(d, '%m/%d/%Y') WHEN 11 THEN strftime(d, '%-d') || th || strftime(d, ' %B %Y')
              WHEN 12 THEN strftime(d, '%Y.%m.%d') WHEN 13 THEN strftime(d, '%Y%m%d') WHEN 14 THEN strftime(d, '%b-%d-%Y')
              WHEN 15 THEN strftime(d, '%d-%b-%Y') WHEN 16 THEN strftime(d, '%Y %b %-d') WHEN 17 THEN strftime(d, '%Y-%m-%dT12:30:00+02:00')
              WHEN 18 THEN strftime(d, '%b %-d, %Y 12:00 PM') WHEN 19 THEN strftime(d, '%A, %B %-d %Y')
              WHEN 20 THEN upper(strftime(d, '%-d %B, %Y.')) WHEN 21 THEN strftime(d, '%B %-d') || th || strftime(d, ', %Y')
              WHEN 22 THEN strftime(d, '%Y/%-m/%-d') ELSE strftime(d, 'Early %Y') END END AS release_date
  FROM (SELECT *, CASE WHEN day(d) IN (1, 21, 31) THEN 'st' WHEN day(d) IN (2, 22) THEN 'nd' WHEN day(d) IN (3, 23) THEN 'rd' ELSE 'th' END AS th
        FROM (SELECT *, DATE '1995-01-01' + CAST(p_partkey AS INTEGER) AS d FROM part)) p
),
"""


def _bindings(games_raw: str) -> str:
    return f"""
{games_raw}games AS (
  SELECT id AS item_id, app_name, developer, lower(developer) AS developer_lc, publisher, genres,
         {_price('price')} AS price,
         rd AS release_date, CAST(COALESCE(year(rd), 0) AS INTEGER) AS release_year
  FROM (SELECT *, {_parse_date('release_date')} AS rd FROM games_raw) g
  WHERE NOT (id IS NULL AND app_name IS NULL AND developer IS NULL AND publisher IS NULL
             AND genres IS NULL AND price IS NULL AND release_date IS NULL)
),
prices AS (SELECT item_id, price FROM games WHERE price IS NOT NULL),
genres AS (
  SELECT item_id, list_transform(genres, lambda e: replace(e, '&amp;', 'and')) AS genres, release_year
  FROM games WHERE genres IS NOT NULL
),
genres_x AS (
  SELECT item_id, genre, release_year, lower(genre) AS genre_lc FROM (
    SELECT item_id, release_year,
           unnest(CASE WHEN len(genres) = 0 THEN [NULL::VARCHAR] ELSE genres END) AS genre
    FROM genres) x
),
devs AS (SELECT item_id, developer, developer_lc, release_year FROM games WHERE developer IS NOT NULL),
ol AS (SELECT l.*, o.o_custkey FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
user_items AS (
  SELECT o_custkey AS user_id,
         CASE WHEN l_linenumber = 7 THEN NULL ELSE l_partkey END AS item_id,
         CASE WHEN l_linenumber = 7 THEN NULL
              ELSE round_even(CAST(CAST(l_quantity * 7 AS BIGINT) AS DOUBLE) / 60.0::DOUBLE, 2) END AS playtime
  FROM ol
),
item_counts AS (
  SELECT o_custkey AS user_id, count(CASE WHEN l_linenumber = 7 THEN NULL ELSE l_partkey END) AS items_count
  FROM ol GROUP BY o_custkey
),
reviews AS (
  SELECT user_id, item_id, recommend, sentiment, rd AS review_date, CAST(year(rd) AS INTEGER) AS review_year
  FROM (SELECT o_custkey AS user_id, l_partkey AS item_id,
               CASE WHEN l_linenumber = 6 THEN NULL ELSE l_returnflag <> 'R' END AS recommend,
               CAST((l_orderkey + l_linenumber) % 3 AS INTEGER) AS sentiment,
               {_parse_date(f"replace({_POSTED}, 'Posted ', '')")} AS rd
        FROM ol) r
)"""


def _with(body: str, extra: str = "") -> str:
    ctes = _bindings(_GAMES_RAW) + ("," + extra if extra else "")
    return f"WITH {ctes}\n{body}"


def _edge(body: str) -> str:
    return f"WITH {_bindings(_GAMES_EDGE)}\n{body}"


def _describe(src: str, col: str) -> str:
    x = f"CAST({col} AS DOUBLE)"
    return (f"SELECT count({x}) AS count, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, "
            f"min({x}) AS min, quantile_cont({x}, 0.25) AS q25, quantile_cont({x}, 0.5) AS q50, "
            f"quantile_cont({x}, 0.75) AS q75, max({x}) AS max FROM {src}")


def _top(src: str, cols: str, order: str, k: int) -> str:
    return (f"SELECT {cols}, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank FROM {src} "
            f"QUALIFY rank <= {k}")


# ----------------------------------------------------------------------- sentiment in SQL

# Fixed values of the published method, stated here on their own.
_NEGATE = (
    "aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt mightnt "
    "mustnt neither neednt never none nope nor not nothing nowhere oughtnt shant shouldnt "
    "uhuh wasnt werent without wont wouldnt rarely seldom despite").split()
_UP = (
    "absolutely amazingly awfully completely considerably decidedly deeply effing enormously "
    "entirely especially exceptionally extremely fabulously flipping flippin fricking frickin "
    "frigging friggin fully fucking greatly hella highly hugely incredibly intensely majorly "
    "more most particularly purely quite really remarkably so substantially thoroughly "
    "totally tremendously uber unbelievably unusually utterly very").split()
_DOWN = (
    "almost barely hardly kinda kindof kind-of less little marginally occasionally partly "
    "scarcely slightly somewhat sorta sortof sort-of").split()
_LEXICON = {"that": 1.9, "for": 0.8, "was": -1.5, "and": -0.4, "good": 1.9, "bad": -2.5, "great": 3.1, "not": 0.0,
            "like": 1.5, ":)": 2.0, "très": 0.7, "no": -1.2, "for that": 1.1, "for the was": -0.9, "that and": -1.3, "but great": 2.4}
_UP = _UP + ["that was"]
# Phrases, longest first where they start alike; each becomes one token, from left to right.
_PHRASES = ["for the was", "for that", "that was", "and that", "that and", "but great"]


def _merged(tokens: str) -> str:
    """The token list with phrases as one token: tokens are wrapped in two separators, and what
    stands between the matches of one pattern is put together with the joined matches."""
    a, b = "\x1f", "\x1e"
    pattern = f"{a}(?:{'|'.join(p.replace(' ', b + a) for p in _PHRASES)}){b}"
    joined = f"('{a}' || array_to_string({tokens}, '{b}{a}') || '{b}')"
    found = f"regexp_extract_all({joined}, '{pattern}', 0, 'i')"
    rest = f"string_split_regex({joined}, '(?i){pattern}')"
    return (f"list_filter(string_split(array_to_string(list_transform(range(1, len({rest}) + 1), lambda k: {rest}[k] || "
            f"coalesce('{a}' || replace(trim({found}[k], '{a}{b}'), '{b}{a}', ' ') || '{b}', '')), ''), '{b}'), lambda t: t <> '')")


def _list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _is_caps(t: str) -> str:
    return f"({t} = upper({t}) AND {t} <> lower({t}))"


def _modified(k: int) -> str:
    """Score ``s`` after the token ``k`` before it: booster, then negation."""
    damp = {1: 1.0, 2: 0.95, 3: 0.9}[k]
    step = (f"((CASE WHEN p{k} IN {_list(_UP)} THEN 0.293::DOUBLE ELSE -0.293::DOUBLE END) "
            f"+ CASE WHEN {_is_caps(f'r{k}')} AND mixed THEN 0.733::DOUBLE ELSE 0.0::DOUBLE END)")
    boosted = (f"CASE WHEN p{k} IN {_list(_UP)} OR p{k} IN {_list(_DOWN)} "
               f"THEN s + (CASE WHEN s < 0 THEN -{step} ELSE {step} END) * {damp}::DOUBLE ELSE s END")
    never = {1: "", 2: "WHEN p2 = 'never' AND p1 IN ('so', 'this') THEN t * 1.5::DOUBLE ",
             3: "WHEN p3 = 'never' AND (p1 IN ('so', 'this') OR p2 IN ('so', 'this')) THEN t * 1.25::DOUBLE "}[k]
    return (f"s{k} AS (SELECT * EXCLUDE (s, t), CASE WHEN p{k} IS NULL OR p{k} IN {_list(_LEXICON)} THEN s "
            f"{never}WHEN p{k} IN {_list(_NEGATE)} OR contains(p{k}, 'n''t') THEN t * -0.74::DOUBLE ELSE t END AS s "
            f"FROM (SELECT *, {boosted} AS t FROM s{k - 1}))")


def _sentiment_ctes(src: str) -> str:
    """CTEs over ``src(doc_id, text)`` ending in ``scored(doc_id, compound)``."""
    lex = ", ".join(f"('{t}', {v!r}::DOUBLE)" for t, v in _LEXICON.items())
    marks = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"
    return f"""
lex(token, valence) AS (VALUES {lex}),
raw0 AS (SELECT doc_id, text, list_transform(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> ''),
               lambda t: CASE WHEN length(trim(t, {marks})) <= 2 THEN t ELSE trim(t, {marks}) END) AS r0 FROM {src}),
raw AS (SELECT doc_id, text, r0, list_transform({_merged('r0')}, lambda t: trim(t, '\x1f')) AS rt FROM raw0),
docs AS (SELECT doc_id, text, rt, list_transform(rt, lambda t: lower(t)) AS toks,
                len(list_filter(r0, lambda t: {_is_caps('t')})) AS ncaps, len(r0) AS n0 FROM raw),
tok AS (
  SELECT doc_id, i, toks[i] AS w, rt[i] AS r, toks[i + 1] AS nx, (ncaps > 0 AND ncaps < n0) AS mixed,
         CASE WHEN i > 1 THEN rt[i - 1] END AS r1, CASE WHEN i > 2 THEN rt[i - 2] END AS r2, CASE WHEN i > 3 THEN rt[i - 3] END AS r3,
         COALESCE(list_position(toks, 'but'), 0) AS bp
  FROM (SELECT doc_id, toks, rt, ncaps, n0, unnest(range(1, len(toks) + 1)) AS i FROM docs) z
),
s0 AS (SELECT * EXCLUDE (valence), valence + CASE WHEN {_is_caps('r')} AND mixed THEN sign(valence) * 0.733::DOUBLE ELSE 0.0::DOUBLE END AS s
       FROM (SELECT * EXCLUDE (valence), CASE WHEN coalesce(p1 = 'no', false) OR coalesce(p2 = 'no', false)
                      OR (coalesce(p3 = 'no', false) AND p1 IN ('or', 'nor')) THEN valence * -0.74::DOUBLE
                    WHEN w = 'no' AND nx IN {_list(_LEXICON)} THEN 0.0::DOUBLE ELSE valence END AS valence
             FROM (SELECT tok.*, valence, lower(r1) AS p1, lower(r2) AS p2, lower(r3) AS p3 FROM tok JOIN lex ON w = token))),
{_modified(1)},
{_modified(2)},
{_modified(3)},
contrib AS (
  SELECT doc_id, (CASE WHEN p1 = 'least' AND NOT COALESCE(p2 IN ('at', 'very'), false) THEN s * -0.74::DOUBLE ELSE s END)
         * (CASE WHEN bp = 0 THEN 1.0::DOUBLE WHEN i < bp THEN 0.5::DOUBLE WHEN i > bp THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) AS c
  FROM s3
),
summed AS (
  SELECT d.doc_id, d.text, COALESCE(s.total, 0.0::DOUBLE) AS total,
         length(d.text) - length(replace(d.text, '!', '')) AS bangs,
         length(d.text) - length(replace(d.text, '?', '')) AS quests
  FROM docs d LEFT JOIN (SELECT doc_id, sum(c) AS total FROM contrib GROUP BY doc_id) s ON d.doc_id = s.doc_id
),
amped AS (
  SELECT doc_id, text, total,
         least(bangs, 4) * 0.292::DOUBLE
         + CASE WHEN quests <= 1 THEN 0.0::DOUBLE WHEN quests <= 3 THEN quests * 0.18::DOUBLE ELSE 0.96::DOUBLE END AS amp
  FROM summed
),
scored AS (
  SELECT doc_id,
         CASE WHEN text IS NULL THEN NULL
              ELSE greatest(-1.0::DOUBLE, least(1.0::DOUBLE, s / sqrt(s * s + 15.0::DOUBLE))) END AS compound
  FROM (SELECT doc_id, text, CASE WHEN total > 0 THEN total + amp WHEN total < 0 THEN total - amp
                                  ELSE total END AS s FROM amped) q
)"""


def _class(expr: str) -> str:
    return (f"CAST(CASE WHEN {expr} >= 0.05 THEN 2 WHEN {expr} <= -0.05 THEN 0 "
            f"ELSE 1 END AS INTEGER)")


# ----------------------------------------------------------------------- recommender in SQL

_SCORE = ("CAST(CASE WHEN NOT COALESCE(recommend, false) THEN 0 WHEN sentiment IN (0, 1, 2) "
          "THEN sentiment + 1 END AS INTEGER)")

_RECO = f"""
ui AS (
  SELECT user_id, item, avg(score) AS score FROM (
    SELECT r.user_id, g.app_name AS item, {_SCORE} AS score
    FROM reviews r JOIN games g ON r.item_id = g.item_id WHERE g.app_name IS NOT NULL) s
  WHERE score IS NOT NULL AND user_id IS NOT NULL GROUP BY user_id, item
),
us AS (SELECT user_id, avg(score) AS m, min(score) AS lo, max(score) AS hi FROM ui GROUP BY user_id),
nz AS (
  SELECT user_id, item, v FROM (
    SELECT ui.user_id, ui.item, (ui.score - us.m) / (us.hi - us.lo) AS v
    FROM ui JOIN us ON ui.user_id = us.user_id WHERE us.hi > us.lo) n
  WHERE abs(v) > 1e-12
),
inorm AS (SELECT item, sqrt(sum(v * v)) AS n FROM nz GROUP BY item),
w AS (SELECT nz.user_id, nz.item, nz.v / inorm.n AS w FROM nz JOIN inorm ON nz.item = inorm.item),
pairs AS (
  SELECT a.item AS item_a, b.item AS item_b, round(sum(a.w * b.w), 6) + 0.0 AS sim
  FROM w a JOIN w b ON a.user_id = b.user_id AND a.item < b.item GROUP BY a.item, b.item
)"""


def _k1(where: str, keys: str) -> str:
    return (f"SELECT {keys}, count(*) AS item_count, count(*) FILTER (WHERE price = 0) AS free_items, "
            f"{_pct_label('count(*) FILTER (WHERE price = 0) / count(*)')} AS free_content "
            f"FROM games WHERE {where} GROUP BY {keys}")


_K2 = """
spend AS (SELECT u.user_id, COALESCE(sum(p.price), 0.0::DOUBLE) AS s
          FROM user_items u LEFT JOIN prices p ON u.item_id = p.item_id GROUP BY u.user_id),
rate AS (SELECT user_id, avg(CAST(recommend AS DOUBLE)) AS r FROM reviews GROUP BY user_id),
cnt AS (SELECT user_id, max(items_count) AS items_count FROM item_counts GROUP BY user_id),
k2 AS (
  SELECT COALESCE(spend.user_id, rate.user_id, cnt.user_id) AS user_id,
         round(COALESCE(spend.s, 0.0::DOUBLE), 2) AS money_spent,
         """ + _pct_label("rate.r") + """ AS recommend_pct, cnt.items_count
  FROM spend FULL JOIN rate ON spend.user_id = rate.user_id
       FULL JOIN cnt ON COALESCE(spend.user_id, rate.user_id) = cnt.user_id
)"""

_K3 = """
gp AS (SELECT g.genre_lc, g.release_year, u.user_id, u.playtime
       FROM genres_x g JOIN user_items u ON g.item_id = u.item_id
       WHERE g.genre_lc IS NOT NULL AND u.playtime IS NOT NULL AND u.item_id IS NOT NULL),
py AS (SELECT genre_lc, user_id, release_year, sum(playtime) AS h FROM gp WHERE user_id IS NOT NULL
       GROUP BY genre_lc, user_id, release_year),
pu AS (SELECT genre_lc, user_id, round(sum(h), 2) AS total FROM py GROUP BY genre_lc, user_id),
best AS (SELECT genre_lc, user_id,
                CAST(row_number() OVER (PARTITION BY genre_lc ORDER BY total DESC, user_id ASC) AS INTEGER) AS user_rank
         FROM pu QUALIFY user_rank <= 1),
k3 AS (SELECT py.genre_lc, best.user_rank, py.user_id, py.release_year, round(py.h, 2) AS hours
       FROM py JOIN best ON py.genre_lc = best.genre_lc AND py.user_id = best.user_id)"""

_POS = "recommend AND sentiment = 2 AND review_year IS NOT NULL"

ORACLE_SQL: dict[str, str] = {
    # ---------------------------------------------------------------- sources
    "ingest_json_lines": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "json_flatten": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS \"props.k\" FROM events",
    "library_prices_null_safe": _edge(
        f"SELECT u.item_id, count(*) AS rows, round(sum(p.price), 2) AS price_sum FROM user_items u LEFT JOIN (SELECT id, {_price('price')} AS price FROM games_raw) p "
        "ON p.id IS NOT DISTINCT FROM u.item_id AND p.price IS NOT NULL GROUP BY u.item_id"),
    "ingest_json_files": _with(
        "SELECT CAST(id AS VARCHAR) AS id, app_name, developer, price, release_date, array_to_string(genres, '|') AS genres, "
        "CAST(id % 50 AS VARCHAR) AS size FROM games_raw"),
    "first_item_count": _with(
        "SELECT user_id, arg_min(n, k) AS items_count FROM (SELECT CAST(o_custkey AS VARCHAR) AS user_id, l_orderkey AS k, "
        "count(*) FILTER (WHERE l_linenumber <> 7) AS n FROM ol GROUP BY o_custkey, l_orderkey) GROUP BY user_id"),
    "ingest_literal_lines": _with(
        "SELECT CAST(o_custkey AS VARCHAR) AS user_id, "
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_partkey AS VARCHAR) END AS item_id, "
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity * 7 AS BIGINT) END AS playtime_forever FROM ol"),
    "full_scan": "SELECT * FROM part",
    "quarantine_literal_lines": (
        "SELECT CASE o_orderkey % 5 WHEN 1 THEN '{''user_id'': u''' || o_custkey || ''', broken' "
        "WHEN 2 THEN '{''user_id'': ''' || o_custkey || ''', ''items_count'': ''many'', ''items'': []}' "
        "ELSE '{''user_id'': ''' || o_custkey || ''', ''items'': ''oops''}' END AS line, "
        "CASE o_orderkey % 5 WHEN 1 THEN NULL WHEN 2 THEN 'items_count' ELSE 'items' END AS field "
        "FROM orders WHERE o_orderkey % 5 IN (1, 2, 3)"),
    "scan_projected": "SELECT p_partkey AS item_id, p_brand AS developer FROM part",
    "parquet_roundtrip": _with("SELECT * FROM devs"),
    # ---------------------------------------------------------------- projection / cast
    "derive_game_dev": _with("SELECT * FROM devs"),
    "numeric_coerce": _edge(f"SELECT id AS item_id, {_number('price')} AS price_num FROM games_raw"),
    "playtime_hours": _with("SELECT * FROM user_items"),
    "percent_label": _with(
        f"SELECT user_id, {_pct_label('avg(CAST(recommend AS DOUBLE))')} AS recommend_pct "
        "FROM reviews WHERE user_id IS NOT NULL GROUP BY user_id"),
    # ---------------------------------------------------------------- filters
    "drop_all_null": _edge(
        "SELECT id, app_name, developer, publisher, array_to_string(genres, '|') AS genres, price, release_date FROM games_raw "
        "WHERE NOT (id IS NULL AND app_name IS NULL AND developer IS NULL AND publisher IS NULL AND genres IS NULL "
        "AND price IS NULL AND release_date IS NULL)"),
    "drop_null_subset": _edge("SELECT * FROM prices"),
    "filter_user": _with(f"SELECT * FROM user_items WHERE user_id = {C.USER}"),
    "filter_ci": _with(f"SELECT item_id, developer, price FROM games WHERE developer_lc = '{C.DEVELOPER.lower()}'"),
    "filter_positive_year": _with(
        f"SELECT user_id, item_id FROM reviews WHERE recommend AND sentiment = 2 AND review_year = {C.YEAR}"),
    # ---------------------------------------------------------------- cleaning
    "parse_mixed_dates": _edge(
        f"SELECT id AS item_id, release_date AS release_text, {_parse_date('release_date')} AS release_date FROM games_raw"),
    "normalize_price": _edge(f"SELECT id AS item_id, price AS price_text, {_price('price')} AS price FROM games_raw"),
    "release_year": _edge("SELECT item_id, release_year FROM games"),
    "strip_posted": _with(
        f"SELECT o_custkey AS user_id, l_partkey AS item_id, replace({_POSTED}, 'Posted ', '') AS posted_text FROM ol"),
    "unparsed_values": _edge(
        f"SELECT price AS price_text, count(*) AS rows FROM games_raw "
        f"WHERE price IS NOT NULL AND ({_price('price')}) IS NULL GROUP BY price"),
    # ---------------------------------------------------------------- arrays
    "array_replace": (
        "SELECT p_partkey AS item_id, array_to_string(list_transform([replace(p_name, ' ', '&amp;')], "
        "lambda e: replace(e, '&amp;', 'and')), '|') AS genres FROM part"),
    "explode_genres": _with("SELECT * FROM genres_x"),
    "explode_user_items": _with("SELECT * FROM user_items"),
    "distinct_price_per_item": _edge("SELECT DISTINCT item_id, price FROM prices WHERE item_id IS NOT NULL"),
    # ---------------------------------------------------------------- derived tables
    "build_games": _edge(
        "SELECT item_id, app_name, developer, developer_lc, publisher, array_to_string(genres, '|') AS genres, "
        "price, release_date, release_year FROM games"),
    "build_prices": _edge("SELECT * FROM prices"),
    "build_genres": _with("SELECT item_id, array_to_string(genres, '|') AS genres, release_year FROM genres"),
    "build_user_item_count": _with(
        "SELECT o_custkey AS user_id, count(CASE WHEN l_linenumber = 7 THEN NULL ELSE l_partkey END) AS items_count "
        "FROM ol GROUP BY l_orderkey, o_custkey"),
    "build_user_reviews": _with(
        "SELECT o_custkey AS user_id, 'profiles/' || CAST(o_custkey AS VARCHAR) AS user_url, "
        "CAST(count(*) AS INTEGER) AS review_count FROM ol GROUP BY l_orderkey, o_custkey"),
    "build_user_items": _with(
        "SELECT user_id, string_agg(x, '|' ORDER BY x) AS items FROM (SELECT l_orderkey, o_custkey AS user_id, "
        "CASE WHEN l_linenumber = 7 THEN '-:-' ELSE CAST(l_partkey AS VARCHAR) || ':' || "
        "CAST(CAST(l_quantity * 7 AS BIGINT) AS VARCHAR) END AS x FROM ol) y GROUP BY l_orderkey, user_id"),
    "user_reviews_content": _with(
        "SELECT user_id, 'profiles/' || CAST(user_id AS VARCHAR) AS user_url, string_agg(x, '|' ORDER BY x) AS reviews FROM ("
        "SELECT l_orderkey, o_custkey AS user_id, concat_ws('~', (CASE WHEN l_linenumber = 3 THEN 'isn''t good' WHEN l_linenumber = 5 THEN 'I don''t like it, très :)' WHEN l_returnflag = 'R' THEN 'bad' WHEN l_returnflag = 'A' THEN 'REALLY good' ELSE 'not bad' END || CASE WHEN l_linestatus = 'F' THEN ' but great' ELSE '!' END), "
        "CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST(l_returnflag <> 'R' AS VARCHAR) END, CAST(l_partkey AS VARCHAR), "
        + _POSTED + ") AS x FROM ol) y GROUP BY l_orderkey, user_id"),
    "date_null_report": _edge(
        "SELECT count(*) AS rows, count(*) - count(" + _parse_date("release_date") + ") AS null_dates, "
        "round_even(100.0::DOUBLE * (count(*) - count(" + _parse_date("release_date") + ")) / count(*) * 100.0::DOUBLE, 0) "
        "/ 100.0::DOUBLE AS null_pct FROM games_raw"),
    "release_year_first20": _with(_top(
        "(SELECT release_year, count(*) AS rows, round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM games) * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS pct "
        "FROM games WHERE release_year IS NOT NULL GROUP BY release_year) x", "release_year, rows, pct",
        "rows DESC, release_year ASC", 20)),
    "sentiment_frequency": _with(
        "SELECT sentiment, count(*) AS rows, round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM reviews) * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS pct "
        "FROM reviews WHERE sentiment IS NOT NULL GROUP BY sentiment"),
    "recommend_frequency": _with(
        "SELECT recommend, count(*) AS rows, round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM reviews) * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS pct "
        "FROM reviews WHERE recommend IS NOT NULL GROUP BY recommend"),
    "build_reviews_pre": _with(
        "SELECT o_custkey AS user_id, 'profiles/' || CAST(o_custkey AS VARCHAR) AS user_url, "
        "(CASE WHEN l_linenumber = 3 THEN 'isn''t good' WHEN l_linenumber = 5 THEN 'I don''t like it, très :)' WHEN l_returnflag = 'R' THEN 'bad' WHEN l_returnflag = 'A' THEN 'REALLY good' ELSE 'not bad' END || CASE WHEN l_linestatus = 'F' THEN ' but great' ELSE '!' END) AS review, "
        "CASE WHEN l_linenumber = 6 THEN NULL ELSE l_returnflag <> 'R' END AS recommend, "
        "l_partkey AS item_id, rd AS review_date, CAST(year(rd) AS INTEGER) AS review_year "
        f"FROM (SELECT *, {_parse_date(f'''replace({_POSTED}, 'Posted ', '')''')} AS rd FROM ol) x"),
    "derive_reviews": _with(
        f"SELECT x.user_id, x.recommend, x.item_id, x.review_date, CAST(year(x.review_date) AS INTEGER) AS review_year, "
        f"CASE WHEN x.review IS NULL THEN 1 ELSE {_class('s.compound')} END AS sentiment "
        "FROM rv x LEFT JOIN scored s ON x.review = s.doc_id",
        "rv AS (SELECT o_custkey AS user_id, (CASE WHEN l_linenumber = 3 THEN 'isn''t good' WHEN l_linenumber = 5 THEN 'I don''t like it, très :)' WHEN l_returnflag = 'R' THEN 'bad' WHEN l_returnflag = 'A' THEN 'REALLY good' ELSE 'not bad' END || CASE WHEN l_linestatus = 'F' THEN ' but great' ELSE '!' END) AS review, "
        "CASE WHEN l_linenumber = 6 THEN NULL ELSE l_returnflag <> 'R' END AS recommend, "
        "l_partkey AS item_id, " + _parse_date(_STRIPPED) + " AS review_date FROM ol), "
        "texts AS (SELECT DISTINCT review AS doc_id, review AS text FROM rv WHERE review IS NOT NULL),"
        + _sentiment_ctes("texts")),
    # ---------------------------------------------------------------- joins
    "join_review_names": _with(
        "SELECT r.item_id, r.user_id, r.recommend, r.sentiment, g.app_name "
        "FROM reviews r LEFT JOIN games g ON r.item_id = g.item_id"),
    "join_item_prices": _with(
        "SELECT u.item_id, u.user_id, p.price FROM user_items u LEFT JOIN prices p ON u.item_id = p.item_id"),
    "join_genre_playtime": _with(
        "SELECT g.item_id, g.genre_lc, g.release_year, u.user_id, u.playtime "
        "FROM genres_x g JOIN user_items u ON g.item_id = u.item_id "
        "WHERE g.genre_lc IS NOT NULL AND u.playtime IS NOT NULL AND u.item_id IS NOT NULL"),
    "join_dev_counts": _with(
        "SELECT d.item_id, d.developer, COALESCE(c.n, 0) AS reviews FROM devs d "
        "LEFT JOIN (SELECT item_id, count(*) AS n FROM reviews GROUP BY item_id) c ON d.item_id = c.item_id"),
    # ---------------------------------------------------------------- profiling
    "group_size": _with("SELECT item_id, count(*) AS rows FROM reviews WHERE item_id IS NOT NULL GROUP BY item_id"),
    "playtime_per_user": _with(
        "SELECT user_id, round(COALESCE(sum(playtime), 0.0::DOUBLE), 2) AS hours FROM user_items "
        "WHERE user_id IS NOT NULL GROUP BY user_id"),
    "reviews_per_date": _with(
        "SELECT review_date, count(recommend) AS reviews FROM reviews WHERE user_id IS NOT NULL AND item_id IS NOT NULL "
        "AND recommend IS NOT NULL AND sentiment IS NOT NULL AND review_date IS NOT NULL AND review_year IS NOT NULL "
        "GROUP BY review_date"),
    "sentiment_counts_per_item": _with(
        "SELECT item_id, count(*) FILTER (WHERE sentiment = 2) AS positive, count(*) FILTER (WHERE sentiment = 0) AS negative "
        "FROM reviews WHERE item_id IS NOT NULL GROUP BY item_id"),
    "value_percentages": _with(
        "SELECT genre, count(*) AS rows, round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM genres_x) * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS pct "
        "FROM genres_x WHERE genre IS NOT NULL GROUP BY genre"),
    "null_profile": _edge("\nUNION ALL\n".join(
        f"SELECT '{c}' AS name, '{t}' AS data_type, "
        f"round_even(100.0::DOUBLE * count({c}) / count(*) * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS not_null_pct, "
        f"round_even((100.0::DOUBLE - 100.0::DOUBLE * count({c}) / count(*)) * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS null_pct, "
        f"count(*) - count({c}) AS null_count FROM games"
        for c, t in [("item_id", "bigint"), ("app_name", "string"), ("developer", "string"),
                     ("publisher", "string"), ("genres", "array<string>"), ("price", "double"),
                     ("release_date", "date"), ("release_year", "int")])),
    "sentiment_recommend_crosstab": _with(
        "SELECT sentiment, recommend, count(*) AS rows, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM reviews) AS pct "
        "FROM reviews WHERE sentiment IS NOT NULL AND recommend IS NOT NULL GROUP BY sentiment, recommend"),
    "distinct_count_with_null": _with(
        "SELECT count(DISTINCT review_year) + max(CAST(review_year IS NULL AS INTEGER)) AS distinct_values FROM reviews"),
    "distinct_years": _with("SELECT DISTINCT review_year FROM reviews"),
    "describe_price": _edge(_describe("(SELECT DISTINCT item_id, price FROM prices WHERE item_id IS NOT NULL) x", "price")),
    "describe_playtime": _with(_describe("user_items", "playtime")),
    "describe_items_count": _with(_describe("item_counts", "items_count")),
    "top_publishers": _with(_top(
        "(SELECT publisher, count(*) AS rows FROM games WHERE publisher IS NOT NULL GROUP BY publisher) x",
        "publisher, rows", "rows DESC, publisher ASC", 5)),
    "top_developers": _with(_top(
        "(SELECT developer, count(*) AS rows FROM games WHERE developer IS NOT NULL GROUP BY developer) x",
        "developer, rows", "rows DESC, developer ASC", 5)),
    "genre_counts": _with("SELECT genre, count(*) AS rows FROM genres_x WHERE genre IS NOT NULL GROUP BY genre"),
    "games_per_year": _with(
        "SELECT release_year, CASE WHEN release_year = 0 THEN 'no data' ELSE CAST(release_year AS VARCHAR) END "
        "AS year_label, count(*) AS rows FROM genres_x WHERE release_year IS NOT NULL GROUP BY release_year"),
    "sort_nulls_last": _with(
        "SELECT review_year, count(*) AS rows, "
        "CAST(row_number() OVER (ORDER BY review_year ASC NULLS LAST) AS INTEGER) AS pos "
        "FROM reviews GROUP BY review_year"),
    "top20_playtime": _with(_top(
        "(SELECT user_id, round(COALESCE(sum(playtime), 0.0::DOUBLE), 2) AS hours FROM user_items "
        "WHERE user_id IS NOT NULL GROUP BY user_id) x", "user_id, hours", "hours DESC, user_id ASC", 20)),
    "top20_items_count": _with(_top("item_counts", "user_id, items_count", "items_count DESC, user_id ASC", 20)),
    # ---------------------------------------------------------------- sentiment
    "sentiment_compound": "WITH " + _sentiment_ctes("documents").lstrip() +
                          "\nSELECT doc_id, round(compound, 6) + 0.0 AS compound FROM scored",
    "sentiment_class": "WITH " + _sentiment_ctes("documents").lstrip() +
                       f"\nSELECT doc_id, {_class('compound')} AS sentiment FROM scored",
    # ---------------------------------------------------------------- recommender
    "recommend_score": _with(f"SELECT user_id, item_id, {_SCORE} AS score FROM reviews"),
    "user_item_scores": _with("SELECT user_id, item, round(score, 6) AS score FROM ui", _RECO),
    "normalize_scores": _with("SELECT user_id, item, round(v, 6) + 0.0 AS v FROM nz", _RECO),
    "item_similarity": _with("SELECT item_a, item_b, sim FROM pairs", _RECO),
    "similar_items_topk": _with(
        "SELECT item, CAST(row_number() OVER (PARTITION BY item ORDER BY sim DESC, \"similar\" ASC) AS INTEGER) AS rank, "
        "\"similar\", sim FROM (SELECT a.item, b.item AS \"similar\", COALESCE(p.sim, 0.0::DOUBLE) + 0.0 AS sim "
        "FROM (SELECT DISTINCT item FROM ui) a JOIN (SELECT DISTINCT item FROM ui) b ON a.item <> b.item "
        "LEFT JOIN pairs p ON p.item_a = least(a.item, b.item) AND p.item_b = greatest(a.item, b.item)) x QUALIFY rank <= 5", _RECO),
    "recommend_item": _with(
        f"SELECT '{C.ITEM}' AS item, CAST(row_number() OVER (ORDER BY sim DESC, \"similar\" ASC) AS INTEGER) AS rank, "
        "\"similar\", sim FROM ("
        "  SELECT i.item AS \"similar\", COALESCE(p.sim, 0.0::DOUBLE) + 0.0 AS sim"
        "  FROM (SELECT DISTINCT item FROM ui) i LEFT JOIN ("
        f"    SELECT item_b AS other, sim FROM pairs WHERE item_a = '{C.ITEM}'"
        f"    UNION ALL SELECT item_a AS other, sim FROM pairs WHERE item_b = '{C.ITEM}') p ON i.item = p.other"
        f"  WHERE i.item <> '{C.ITEM}' AND EXISTS (SELECT 1 FROM ui WHERE item = '{C.ITEM}')) c "
        "QUALIFY rank <= 5", _RECO),
    # ---------------------------------------------------------------- questions
    "developer_free_share": _with(_k1(f"developer_lc = '{C.DEVELOPER.lower()}'", "release_year")),
    "developer_free_share_all": _with(_k1("developer_lc IS NOT NULL", "developer_lc, release_year")),
    "user_data": _with(
        f"SELECT s.user_id, COALESCE(k2.money_spent, 0.0::DOUBLE) AS money_spent, k2.recommend_pct, k2.items_count "
        f"FROM (SELECT CAST({C.USER} AS BIGINT) AS user_id) s LEFT JOIN k2 ON s.user_id = k2.user_id", _K2),
    "user_data_all": _with("SELECT * FROM k2 WHERE user_id IS NOT NULL", _K2),
    "user_for_genre": _with(f"SELECT user_id, release_year, hours FROM k3 WHERE genre_lc = '{C.GENRE.lower()}'", _K3),
    "user_for_genre_all": _with("SELECT * FROM k3", _K3),
    "best_developer_year": _with(
        f"SELECT {C.YEAR} AS review_year, s.rank, g.developer, g.positive_reviews "
        "FROM (VALUES (1), (2), (3)) s(rank) LEFT JOIN g ON s.rank = g.rank",
        f"cnt AS (SELECT item_id, count(*) AS n FROM reviews WHERE {_POS} AND review_year = {C.YEAR} GROUP BY item_id),"
        "pd AS (SELECT d.developer, CAST(COALESCE(sum(c.n), 0) AS BIGINT) AS positive_reviews "
        "       FROM devs d LEFT JOIN cnt c ON d.item_id = c.item_id GROUP BY d.developer),"
        "top AS (SELECT developer, positive_reviews, "
        "        CAST(row_number() OVER (ORDER BY positive_reviews DESC, developer ASC) AS INTEGER) AS rank "
        "        FROM pd QUALIFY rank <= 3),"
        "g AS (SELECT * FROM top WHERE COALESCE((SELECT positive_reviews FROM top WHERE rank = 2), 0) <> 0)"),
    "best_developer_all_years": _with(
        "SELECT review_year, CAST(row_number() OVER (PARTITION BY review_year ORDER BY positive_reviews DESC, "
        "developer ASC) AS INTEGER) AS rank, developer, positive_reviews FROM pd QUALIFY rank <= 3",
        f"cnt AS (SELECT review_year, item_id, count(*) AS n FROM reviews WHERE {_POS} GROUP BY review_year, item_id),"
        "pd AS (SELECT c.review_year, d.developer, CAST(sum(c.n) AS BIGINT) AS positive_reviews "
        "       FROM cnt c JOIN devs d ON c.item_id = d.item_id GROUP BY c.review_year, d.developer)"),
    "developer_reviews_analysis": _with(
        "SELECT d.developer, count(*) FILTER (WHERE r.sentiment = 0) AS negative, count(*) FILTER (WHERE r.sentiment = 2) AS positive "
        f"FROM devs d LEFT JOIN reviews r ON d.item_id = r.item_id WHERE d.developer_lc = '{C.DEVELOPER.lower()}' "
        "GROUP BY d.developer"),
    "developer_reviews_all": _with(
        "SELECT d.developer, CAST(COALESCE(sum(c.neg), 0) AS BIGINT) AS negative, "
        "CAST(COALESCE(sum(c.pos), 0) AS BIGINT) AS positive "
        "FROM devs d LEFT JOIN (SELECT item_id, count(*) FILTER (WHERE sentiment = 0) AS neg, count(*) FILTER (WHERE sentiment = 2) AS pos "
        "FROM reviews GROUP BY item_id) c ON d.item_id = c.item_id GROUP BY d.developer"),
}
