"""Language identification in two steps: the family, then one-versus-one linear SVMs within it.

Features are byte trigrams of the text with A-Z lower-cased and other ASCII signs as
blanks, hashed to ``BUCKETS`` and counted over the whole text; every classifier is a
linear SVM over their relative frequencies (one against the rest for families, one
against one for the languages of a family), trained by stochastic subgradients on a
bounded sample.  A text's scores are sums of weights over its trigrams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treegate.llm import kernels as K
from treegate.llm.common import carried, unpacked
from treegate.llm.sample import bounded_sample

BUCKETS = 1 << 16
#: Training rows of a language, and of all languages, at most.
PER_LANGUAGE, ALL_ROWS = 600, 12_000

#: Language families by ISO 639 code; any other code is a family of its own.
FAMILIES = {
    "germanic": ["da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "indic": ["bn", "gu", "hi", "mr", "pa", "ur"],
    "sinitic": ["yue", "zh"],
    "semitic": ["ar", "he"],
    "turkic": ["az", "kk", "tr", "uz"],
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}

_SIGNS = K.LOWER.copy()
_SIGNS[[c for c in range(128) if not chr(c).isalpha()]] = 0x20


def _trigrams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams, and per row where its own begin (length rows + 1); a text is framed by blanks."""
    n, sizes = len(offs) - 1, np.diff(offs)
    framed = np.full(len(buf) + 2 * n, 0x20, np.uint8)
    framed[np.arange(len(buf)) + 2 * np.repeat(np.arange(n), sizes) + 1] = _SIGNS[buf]
    if len(framed) < 3:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    x = framed.astype(np.uint32)
    v = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
    bucket = (v * np.uint32(2654435761)) >> np.uint32(16)
    start = offs + 2 * np.arange(n + 1)  # in framed bytes
    own = np.repeat(np.arange(n), sizes + 2)[: len(bucket)]
    inside = np.arange(len(bucket)) + 2 < start[own + 1]
    return bucket[inside], np.concatenate([[0], np.cumsum(sizes)])


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8"))


def _svm(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, epochs: int = 12, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM: Pegasos steps on the hinge loss, averaged over the second half."""
    rng = np.random.default_rng(11)
    w, total, b, total_b, scale, taken = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0, 1.0, 0
    weight = np.where(signs > 0, 0.5 / max(1, (signs > 0).sum()), 0.5 / max(1, (signs < 0).sum())) * len(signs)
    t = 0
    for epoch in range(epochs):
        for i in rng.permutation(len(rows)):
            t += 1
            step = 1.0 / (decay * (t + 1 / decay / 4))
            at, x = rows[i]
            margin = signs[i] * (scale * (w[at] @ x) + b)
            scale *= 1 - step * decay
            if margin < 1:
                w[at] += step * weight[i] * signs[i] / scale * x
                b += 0.01 * step * weight[i] * signs[i]
        if 2 * epoch >= epochs:
            total += scale * w
            total_b += b
            taken += 1
    return total / taken, total_b / taken


@dataclass
class Model:
    """Columns of ``weights`` are the family classifiers, then the pairs of languages."""

    families: list[list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, buf: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(offs) - 1
        if not self.families:
            return ["und"] * n, np.zeros(n)
        bucket, start = _trigrams(buf, offs)
        counts = np.diff(start)
        letter = np.zeros(n, bool)
        ascii_letter = np.concatenate([[0], np.cumsum((K.LOWER[buf] >= 97) & (K.LOWER[buf] <= 122))])
        letter = ascii_letter[offs[1:]] > ascii_letter[offs[:-1]]
        for i in np.flatnonzero(~letter & (counts > 0)):
            letter[i] = _has_letter(buf[offs[i] : offs[i + 1]].tobytes())
        sums = np.zeros((n, self.weights.shape[1]))
        filled = np.flatnonzero(counts)
        if len(filled):
            sums[filled] = np.add.reduceat(self.weights[bucket], start[filled], axis=0, dtype=np.float64)
        sums = sums / np.maximum(counts, 1)[:, None] + self.bias
        family = sums[:, : len(self.families)]
        best = family.argmax(axis=1)
        rest = np.where(np.arange(len(self.families)) == best[:, None], -np.inf, family).max(axis=1)
        score = _sure((family.max(axis=1) - rest) / 2) if len(self.families) > 1 else np.ones(n)
        names = np.full(n, "und", dtype=object)
        for f, languages in enumerate(self.families):
            at = np.flatnonzero(best == f)
            votes = np.zeros((len(at), len(languages)))
            margin = np.zeros((len(at), len(languages)))
            for p, (a, b) in enumerate(self.pairs):
                if a in languages:
                    m = sums[at, len(self.families) + p]
                    i, j = languages.index(a), languages.index(b)
                    votes[m >= 0, i] += 1
                    votes[m < 0, j] += 1
                    margin[:, i] += m
                    margin[:, j] -= m
            won = (votes + 1e-9 * margin).argmax(axis=1)
            names[at] = np.array(languages, dtype=object)[won]
            if len(languages) > 1:
                score[at] *= _sure(margin[np.arange(len(at)), won] / (len(languages) - 1))
        names[~letter] = "und"
        return names.tolist(), np.where(letter, score, 0.0)


def _sure(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4 * np.clip(margin, -8, 8)))


def train(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """rows: (language, buckets, relative frequencies)."""
    rows = sorted(rows, key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
    languages = sorted({r[0] for r in rows})
    groups: dict[str, list[str]] = {}
    for x in languages:
        groups.setdefault(_FAMILY.get(x, x), []).append(x)
    families = [groups[k] for k in sorted(groups)]
    columns = []
    for members in families:
        if len(families) == 1:
            columns.append((np.zeros(BUCKETS), 0.0))
        else:
            columns.append(_svm([(b, x) for _, b, x in rows], np.array([1.0 if y in members else -1.0 for y, _, _ in rows])))
    pairs = [p for members in families for p in combinations(members, 2)]
    for a, b in pairs:
        own = [r for r in rows if r[0] in (a, b)]
        columns.append(_svm([(i, x) for _, i, x in own], np.array([1.0 if y == a else -1.0 for y, _, _ in own])))
    weights = np.stack([w for w, _ in columns], axis=1).astype(np.float32) * _SCALE if columns else np.zeros((BUCKETS, 0), np.float32)
    return Model(families, pairs, weights, np.array([b for _, b in columns]))


#: Relative frequencies are tiny; training sees them times this.
_SCALE = 30.0


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, buf, offs in K.slices(batch, "text"):
            bucket, start = _trigrams(buf, offs)
            at, x = [], []
            for i in range(rows.num_rows):
                b, c = np.unique(bucket[start[i] : start[i + 1]], return_counts=True)
                at.append(b.astype(np.int32))
                x.append((c / max(1, c.sum()) * _SCALE).astype(np.float32))
            yield pa.record_batch([rows.column("lang"), pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float32()))], names=["lang", "at", "x"])


def fit(docs: DataFrame, learn: F.Column, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from at most ``per_language`` rows of each language among those where ``learn`` holds, fewer where there are over 20."""
    rows = docs.select("doc_id", "text", "lang", learn.alias("__learn")).where("__learn and lang is not null and lang <> 'und' and octet_length(text) >= 20")
    languages = rows.select(F.count_distinct("lang")).first()[0]
    each = min(per_language, max(20, ALL_ROWS // max(1, languages)))
    sample = bounded_sample(rows.select("doc_id", "text", "lang"), "lang", each, "doc_id", "text")
    got = sample.select("lang", "text").mapInArrow(_features, "lang string, at array<int>, x array<float>").toArrow()
    return train([(y, np.asarray(a), np.asarray(x, np.float64)) for y, a, x in zip(got.column("lang").to_pylist(), got.column("at").to_pylist(), got.column("x").to_pylist(), strict=True)])


def identify(docs: DataFrame, model: Model, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with lang_pred (a learned language, or ``und`` for null texts and texts without a letter) and score (0 to 1).

    ``into`` names the two; columns of ``docs`` that have these names give way. Every
    whole text is scored; ``und`` has score 0. Other columns pass through whatever their
    names, so repeated rows and null ids change nothing; an empty table gives an empty
    result. A model that saw no language predicts ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows, a column per classifier: independent of the corpus
    names, packed = carried(docs, *into)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release_caches()
        for batch in batches:
            for rows, buf, offs in K.slices(batch, "text"):
                lang, sure = shared.value.predict(buf, offs)
                yield pa.record_batch([*rows.columns, pa.array(lang, pa.string()), pa.array(sure, pa.float64())], names=["row", "text", "lang", "sure"])

    schema = T.StructType([*packed.schema.fields, T.StructField("lang", T.StringType()), T.StructField("sure", T.DoubleType())])
    return packed.mapInArrow(score, schema).select(*unpacked(names), F.col("lang").alias(into[0]), F.col("sure").alias(into[1]))
