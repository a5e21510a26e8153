"""Learned decision lists over text statistics.

Sequential covering in the manner of IREP/RIPPER (Cohen, 1995): a rule is a conjunction
of thresholds that says "bad"; it grows on two thirds of the labelled rows, adding the
threshold of the greatest FOIL gain, is pruned on the other third by dropping its last
thresholds, and is kept while it is precise there; the rows it covers go and the next
rule follows.  The list is emitted as one ordered Spark ``CASE WHEN``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treegate.llm import kernels as K
from treegate.llm import textstats
from treegate.llm.quality import labelled

#: Training rows of each label, at most; the least precision of a kept rule; rules at most.
PER_LABEL, PRECISION, RULES = 5_000, 0.94, 12

#: Features as Spark expressions over the counts: interpretable, and the same in training and use.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "letter_share": "n_letters / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "duplicate_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "short_word_share": "n_stops / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "words": "cast(n_words as double)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        x = columns[self.feature]
        return x >= self.threshold if self.above else x < self.threshold

    def sql(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, columns: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.holds(columns)
    return hit


def _grow(columns: dict[str, np.ndarray], bad: np.ndarray, longest: int = 4) -> Rule:
    rule: list[Condition] = []
    covered = np.ones(len(bad), bool)
    while len(rule) < longest and (covered & ~bad).any():
        p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
        best, gain = None, 1e-9
        for name, x in columns.items():
            own = x[covered]
            cuts = np.unique(np.quantile(own, np.linspace(0, 1, 65)))
            cuts = (cuts[1:] + cuts[:-1]) / 2
            order = np.sort(own[bad[covered]]), np.sort(own[~bad[covered]])
            below = [np.searchsorted(o, cuts, side="left") for o in order]
            for above, pos, neg in ((False, below[0], below[1]), (True, p - below[0], n - below[1])):
                with np.errstate(divide="ignore", invalid="ignore"):
                    foil = pos * (np.log2(pos / (pos + neg)) - np.log2(p / (p + n)))
                foil = np.where(pos > 0, foil, -1)
                i = int(foil.argmax()) if len(foil) else -1
                if i >= 0 and foil[i] > gain:
                    best, gain = Condition(name, above, float(np.round(cuts[i], 6))), foil[i]
        if best is None:
            break
        rule.append(best)
        covered &= best.holds(columns)
        if not (covered & bad).any():
            return tuple(rule[:-1])
    return tuple(rule)


def _prune(rule: Rule, columns: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float, int]:
    best, value, precision, caught = rule, -2.0, 0.0, 0
    for k in range(len(rule), 0, -1):
        hit = _covers(rule[:k], columns, len(bad))
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        worth = (p - n) / max(1, p + n)
        if worth >= value:
            best, value, precision, caught = rule[:k], worth, p / max(1, p + n), p
    return best, precision, caught


def _tight(rule: Rule) -> Rule:
    """The rule without thresholds that a tighter one of the same feature and side implies."""
    last = {(c.feature, c.above): c for c in sorted(rule, key=lambda c: c.threshold if c.above else -c.threshold)}
    return tuple(c for c in rule if last[c.feature, c.above] is c)


def learn_list(columns: dict[str, np.ndarray], bad: np.ndarray, precision: float = PRECISION, most: int = RULES) -> list[Rule]:
    """Ordered rules that cover bad rows; rows in any order give the same list up to ties."""
    rng = np.random.default_rng(23)
    part = rng.random(len(bad)) < 2 / 3
    out: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(out) < most and (left & bad & part).sum() >= 5:
        cut = lambda at: {k: x[at] for k, x in columns.items()}
        grow_at, prune_at = left & part, left & ~part
        rule = _grow(cut(grow_at), bad[grow_at])
        if not rule:
            break
        rule, sure, caught = _prune(rule, cut(prune_at), bad[prune_at])
        if sure < precision or caught < 3:
            break
        out.append(_tight(rule))
        left &= ~_covers(rule, columns, len(bad))
    return out


def verdict_sql(rules: list[Rule]) -> str:
    """``case when <rule> then false ... else true end`` over the features."""
    if not rules:
        return "true"
    return "case " + " ".join(f"when {' and '.join(c.sql() for c in rule)} then false" for rule in rules) + " else true end"


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, buf, offs in K.slices(batch, "text"):
            counts, _, _ = textstats.counts(buf, offs)
            rest = [c for c in rows.schema.names if c != "text"]
            yield pa.record_batch([*(rows.column(c) for c in rest), *(pa.array(counts[c], pa.int64()) for c in textstats.COUNTS)], names=[*rest, *textstats.COUNTS])


def text_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """The counts of every whole text (null: no words) beside the columns ``keep``."""
    rows = docs.select(*keep, "text")
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "text"), *(T.StructField(c, T.LongType()) for c in textstats.COUNTS)])
    return rows.mapInArrow(_counter, schema)


def _with_features(counts: DataFrame) -> DataFrame:
    return counts.withColumns({name: F.expr(sql) for name, sql in FEATURES.items()})


def fit(docs: DataFrame, labels: DataFrame, learn: F.Column, label: str = "quality", per_label: int = PER_LABEL, precision: float = PRECISION) -> list[Rule]:
    """Learns a list from at most ``per_label`` labelled rows of each label where ``learn`` holds; label 0 is bad."""
    sample, _ = labelled(docs, labels, label, learn, per_label)
    got = _with_features(text_counts(sample, "doc_id", "label")).select("doc_id", "label", *FEATURES).toArrow().to_pandas().sort_values(["doc_id", "label"])
    return learn_list({k: got[k].to_numpy(float) for k in FEATURES}, got["label"].to_numpy() == 0, precision)


def base_failed(n_words: str = "n_words", n_repeat_words: str = "n_repeat_words") -> F.Column:
    return (F.col(n_words) < 10) | (100 * F.col(n_repeat_words) > 20 * F.col(n_words))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, counts..., base_failed, kept) per row of ``docs``.

    ``base_failed``: under ten words, or over a fifth of the words in repeated windows.
    ``kept``: false if so, else the list's verdict. Null and empty texts have no words
    and fail. Repeated rows and null ids are judged like any other; an empty table
    gives an empty result; other columns are not read.
    """
    counts = _with_features(text_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id"))
    failed = base_failed()
    return counts.select("doc_id", *textstats.COUNTS, failed.alias("base_failed"), F.when(failed, False).otherwise(F.expr(verdict_sql(rules))).alias("kept"))
