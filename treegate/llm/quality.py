"""Quality scores by a factorisation machine (Rendle, 2010).

A document's features are its hashed words (relative frequencies), statistics of the
text's structure and metadata of its length.  The score is a logistic function of

    bias + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

whose pairwise part needs no pairs: it is half of sum_f (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2,
linear in the number of features.  Training is AdaGrad on the logistic loss over a
bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treegate.llm import kernels as K
from treegate.llm import textstats
from treegate.llm.sample import bounded_sample

BUCKETS, RANK = 1 << 15, 8
#: Training rows of each label, at most.
PER_LABEL = 3_000

_RATIOS = ["symbols", "upper", "digits", "marks", "letters", "repeats", "duplicates", "distinct", "short"]
_METADATA = ["bytes", "words", "lines", "word_length", "line_length"]
DENSE = len(_RATIOS) + len(_METADATA) + 1


def _dense(c: dict[str, np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Structure statistics and length metadata, each about 0 to 1; the last says that the text is empty."""
    chars, words, lines = (np.maximum(c[k], 1).astype(float) for k in ("word_chars", "n_words", "n_lines"))
    ratios = [c["n_symbols"] / words, c["n_upper"] / chars * 2, c["n_digits"] / chars * 4, c["n_marks"] / words, c["n_letters"] / chars, c["n_repeat_words"] / words, c["n_dup_lines"] / lines, c["n_distinct"] / words, c["n_stops"] / words]
    metadata = [np.log1p(sizes) / 12, np.log1p(c["n_words"]) / 10, np.log1p(c["n_lines"]) / 8, chars / words / 12, np.log1p(words / lines) / 6]
    return np.clip(np.stack([*ratios, *metadata, c["n_words"] == 0], axis=1), 0, 2)


def _features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows x DENSE, and for each distinct bucket of each row: row, bucket, value)."""
    counts, words, row = textstats.counts(buf, offs)
    bucket = (words >> np.uint64(49)).astype(np.int64)
    key, times = np.unique(row * BUCKETS + bucket, return_counts=True)
    at, word = np.divmod(key, BUCKETS)
    value = np.sqrt(times / np.maximum(counts["n_words"], 1)[at])  # squares sum to 1
    return _dense(counts, np.diff(offs)), at, word, value


@dataclass
class Model:
    """Rows of ``w`` and ``v``: the dense features, then the buckets."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        dense, at, word, value = _features(buf, offs)
        n = len(dense)
        linear = dense @ self.w[:DENSE]
        sums, squares = dense @ self.v[:DENSE], dense**2 @ self.v[:DENSE] ** 2
        if len(at):
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            filled, own = at[first], self.v[DENSE + word] * value[:, None]
            linear[filled] += np.add.reduceat(self.w[DENSE + word] * value, first)
            sums[filled] += np.add.reduceat(own, first, axis=0)
            squares[filled] += np.add.reduceat(own**2, first, axis=0)
        z = self.bias + linear + 0.5 * (sums**2 - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40))) if n else np.zeros(0)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], weights: dict[int, float], epochs: int = 12, rate: float = 0.1, decay: float = 1e-5) -> Model:
    """rows: (label, features, values); ``weights`` undoes the sample's share of each label."""
    rng = np.random.default_rng(17)
    size = DENSE + BUCKETS
    bias, w, v = 0.0, np.zeros(size), rng.normal(0, 0.05, (size, RANK))
    gb, gw, gv = 1e-6, np.full(size, 1e-6), np.full((size, RANK), 1e-6)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], rows[i][1].tobytes(), rows[i][2].tobytes()))
    for _ in range(epochs):
        for i in rng.permutation(order):
            y, at, x = rows[i]
            own = v[at] * x[:, None]
            sums = own.sum(axis=0)
            z = bias + w[at] @ x + 0.5 * (sums @ sums - (own**2).sum())
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weights[y]
            dw = g * x + decay * w[at]
            dv = g * x[:, None] * (sums - own) + decay * v[at]
            gb += g * g
            gw[at] += dw * dw
            gv[at] += dv * dv
            bias -= rate * g / np.sqrt(gb)
            w[at] -= rate * dw / np.sqrt(gw[at])
            v[at] -= 0.5 * rate * dv / np.sqrt(gv[at])
    return Model(float(bias), w, v)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, buf, offs in K.slices(batch, "text"):
            dense, at, word, value = _features(buf, offs)
            cut = np.searchsorted(at, np.arange(len(dense) + 1))
            features = [np.concatenate([np.arange(DENSE), DENSE + word[a:b]]).astype(np.int32) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            values = [np.concatenate([d, value[a:b]]).astype(np.float32) for d, a, b in zip(dense, cut[:-1], cut[1:], strict=True)]
            yield pa.record_batch([rows.column("label"), pa.array(features, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["label", "at", "x"])


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: F.Column, per_label: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label, text) of a bounded sample of the labels, and how many rows each label has."""
    rows = labels.where(learn & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).distinct()
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    sample = bounded_sample(rows, "label", per_label, "doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text"), sizes  # per_label rows of two labels


def fit(docs: DataFrame, labels: DataFrame, learn: F.Column, label: str = "quality", per_label: int = PER_LABEL) -> Model:
    """Learns ``label`` (0 or 1) of ``labels`` rows where ``learn`` holds, at most ``per_label`` of each.

    Without labels the model scores everything 0.5.
    """
    sample, sizes = labelled(docs, labels, label, learn, per_label)
    got = sample.select("label", "text").mapInArrow(_sampled, "label int, at array<int>, x array<float>").toArrow()
    rows = [(y, np.asarray(a), np.asarray(x, float)) for y, a, x in zip(got.column("label").to_pylist(), got.column("at").to_pylist(), got.column("x").to_pylist(), strict=True)]
    taken = {y: sum(r[0] == y for r in rows) for y in (0, 1)}
    total, kept = sum(sizes.values()), max(1, len(rows))
    weights = {y: sizes.get(y, 0) / max(1, total) / max(1, taken[y]) * kept for y in (0, 1)}
    return train(rows, weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) per row of ``docs``: 0 to 1, higher where label 1 is likelier.

    Every whole text is scored, null and empty ones too. Repeated rows and null ids
    are scored like any other; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows: independent of the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offs in K.slices(batch, "text"):
                yield pa.record_batch([rows.column("doc_id"), pa.array(shared.value.score(buf, offs), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
