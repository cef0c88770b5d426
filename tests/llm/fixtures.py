"""Small tables for the operator tests: nulls, empty and very long texts, ties, repeated
rows, and extra columns whose names clash with outputs."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    parts = ["ka", "lo", "mi", "ter", "un", "dra", "sel", "po", "vi", "nor"]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)]
    out, line = [], []
    for w in words:
        line.append(w)
        if len(line) >= rng.randint(6, 14):
            out.append(" ".join(line).capitalize() + ".")
            line = []
    if line:
        out.append(" ".join(line).capitalize() + ".")
    return "\n".join(out)


def edge_texts() -> list[str | None]:
    return [None, "", " ", "\n\n", "one", "one two", "a b c d", "a b c d e", "\x0b\x0ctab\tsep\r\nline",
            "É é ÉCOLE Straße ß", "中文 字符 😀 word", "x" * 5000, "<|endoftext|> a <|endoftext|>",
            "the same three the same three the same three", "!!! ### $$$ |||"]


def documents(seed: int = 1, extra: list[str | None] = ()) -> list[tuple]:
    rng = random.Random(seed)
    texts = edge_texts() + [prose(rng, rng.choice([5, 30, 80, 200, 600])) for _ in range(40)] + list(extra)
    return [(i, t, "en", "src", None if t is None else len(t)) for i, t in enumerate(texts)]


def frame(spark, rows, schema=DOCUMENTS):
    return spark.createDataFrame(rows, schema).repartition(3)


def with_clashes(df):
    """Extra columns named like outputs and internals of the operators, and like every name
    with two underscores that a module uses."""
    import re
    from pathlib import Path

    from pyspark.sql import functions as F

    import ludex.llm
    own = {name for path in Path(ludex.llm.__file__).parent.glob("*.py") for name in re.findall(r"\b__[a-z][a-z0-9]*\b(?!__)", path.read_text())}
    for c in sorted(own):
        df = df.withColumn(c, F.lit("clash"))
    for c in ("n_words", "score", "predicted", "kept", "spans", "n_tokens", "sequence_id", "offset", "component_id",
              "h", "key", "line", "grp", "deal", "start", "label", "keep", "n", "sha", "archive", "f", "words"):
        df = df.withColumn(c, F.lit("clash"))
    return df
