"""Documents that hold the awkward cases, and small readers."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, words: int) -> str:
    pool = ["the", "of", "and", "thwh", "erin", "Onted", "ea", "ou", "handin", "tiwh", "été", "ñca", "über", "x1", "3.5"]
    out = []
    for i in range(words):
        out.append(rng.choice(pool) + (rng.choice(pool) if rng.random() < 0.7 else ""))
        if rng.random() < 0.1:
            out[-1] += rng.choice([".", ",", "\n"])
    return " ".join(out)


def documents(spark, texts, extra=False):
    """A documents table from texts, or from (doc_id, text) pairs; ``extra`` adds columns with clashing names."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], SCHEMA)
    if extra:
        names = ["key", "rep", "label", "bands", "length", "rank", "word", "words", "band", "score", "start", "file", "a", "b", "path", "features", "kept", "component_id", "piece", "offset", "items", "found", "row", "n_removed", "packs", "missing", "lang_pred", "sure", "_", "__key", "a b", "c`d"]
        df = df.selectExpr("*", *["'{}' as `{}`".format(n, n.replace("`", "``")) for n in names])
    return df


def awkward() -> list:
    """Null, empty, blank, tiny and very long texts, ties, repeated rows and null ids."""
    rng = random.Random(5)
    long = prose(rng, 6000)
    base = prose(rng, 120)
    near = base.split(" ")
    near[40] = "CHANGED"
    return [
        (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two"), (5, base), (6, base), (7, " ".join(near)),
        (8, long), (9, long[:-50] + " tail"), (10, "漢字 かな 123 !!! <|endoftext|>"), (10, "漢字 かな 123 !!! <|endoftext|>"), (None, base), (None, None), (11, "one"), (12, "a" * 5000), (13, "*** ### 123"),
    ]


def by(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
