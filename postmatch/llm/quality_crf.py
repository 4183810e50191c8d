"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is a position with two labels, good and bad. Line features, those of its neighbours and transitions score a
labelling; forward-backward gives the marginal of each line, and the marginals weighted by line length give the document's quality,
calibrated on the training documents. The field learns from a bounded sample of labelled documents, whose lines all take the
document's label; regularisation and neighbours let single lines differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, byte_slices, folded, free_names, share, shared, table, training_labels, whole

SAMPLE_DOCS = 4_000
#: Features of one line before those of its neighbours are added.
N_BASE = 12
_KIND = np.zeros(256, "uint8")  # 0 other, 1 blank, 2 lower, 3 upper, 4 digit, 5 symbol, 6 mark of a sentence, 7 beyond ASCII
_KIND[list(b" \t\n\r\x0b\f")] = 1
_KIND[ord("a"):ord("z") + 1] = 2
_KIND[ord("A"):ord("Z") + 1] = 3
_KIND[ord("0"):ord("9") + 1] = 4
_KIND[list(b"#*$%&|<>")] = 5
_KIND[list(b"!?")] = 6
_KIND[128:] = 7
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word data[begin:end], ASCII case folded: a running sum of mixed bytes, weighted by their place."""
    starts = np.concatenate([[0], begin])
    place = np.arange(len(data), dtype="uint64") - np.repeat(starts, np.diff(np.append(starts, len(data)))).astype("uint64")
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype("uint64")
    mixed = (low + np.uint64(1)) * (_ODD * (np.uint64(2) * place + np.uint64(1)))
    mixed ^= mixed >> np.uint64(29)
    running = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype="uint64")])
    return (running[end] - running[begin]) * np.uint64(0xBF58476D1CE4E5B9)


def _seen_before(key: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether the same key stands earlier in the same group."""
    order = np.lexsort((key, group))
    same = np.zeros(len(key), bool)
    same[1:] = (key[order][1:] == key[order][:-1]) & (group[order][1:] == group[order][:-1])
    out = np.zeros(len(key), bool)
    out[order] = same
    return out


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length in bytes, document) of every line with a word, over all texts at once."""
    bodies = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(bodies) + b"\n", "uint8")
    kind = _KIND[data]
    doc_end = np.cumsum([len(b) + 1 for b in bodies])
    line_end = np.flatnonzero(data == 10)
    line_begin = np.concatenate([[0], line_end[:-1] + 1])
    doc = np.minimum(np.searchsorted(doc_end - 1, line_end, side="left"), len(bodies) - 1)
    blank = kind == 1
    edge = np.diff(np.concatenate([[1], blank.astype("int8"), [1]]))
    word_begin, word_end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(word_begin):
        return np.zeros((0, N_BASE)), np.zeros(0), np.zeros(0, "int64")
    word_line = np.searchsorted(line_end, word_begin)
    words = np.bincount(word_line, minlength=len(line_end))
    keep = words > 0
    per = lambda mask: np.add.reduceat(mask.astype("int64"), line_begin)
    n = per(~blank)
    low, up, digit, symbol, mark, beyond = (per(kind == k) for k in (2, 3, 4, 5, 6, 7))
    h = _word_hashes(data, word_begin, word_end)
    word_doc = doc[word_line]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (word_doc[1:] == word_doc[:-1])
    trigram = h.copy()
    trigram[2:] = h[2:] * np.uint64(31) + h[1:-1] * np.uint64(17) * _ODD + h[:-2]
    inside = np.zeros(len(h), bool)
    inside[2:] = word_doc[2:] == word_doc[:-2]
    repeated = np.zeros(len(h), bool)
    repeated[inside] = _seen_before(trigram[inside], word_doc[inside])
    count = lambda flag: np.bincount(word_line, weights=flag, minlength=len(line_end))
    w, c = np.maximum(words, 1), np.maximum(n, 1)
    line_sum = np.bincount(word_line, weights=(h >> np.uint64(12)).astype("float64"), minlength=len(line_end))
    copy = np.zeros(len(line_end), bool)
    copy[keep] = _seen_before(line_sum[keep].view("uint64"), doc[keep])
    features = np.stack([
        np.ones(len(w)), np.log1p(words) / 5, np.minimum(c / w, 20) / 10, up / c, digit / c, np.minimum(3 * symbol / w, 3), np.minimum(mark / w, 2),
        count(again) / w, count(repeated) / w, copy, np.minimum(w, 5) < 5, beyond / c,
    ], axis=1)
    return features[keep], n[keep].astype("float64"), doc[keep]


def features_in_slices(texts: list[str], limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`line_features` of many texts, worked out for about ``limit`` characters at a time to bound the memory."""
    parts, start, held = [], 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= limit or i + 1 == len(texts):
            x, size, doc = line_features(texts[start:i + 1])
            parts.append((x, size, doc + start))
            start, held = i + 1, 0
    if not parts:
        return np.zeros((0, N_BASE)), np.zeros(0), np.zeros(0, "int64")
    x, size, doc = (np.concatenate(p) for p in zip(*parts, strict=True))
    return x, size, doc


def with_neighbours(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Adds the features of the previous and the next line of the same document; zeros at its ends."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x) > 1:
        same = (doc[1:] == doc[:-1])[:, None]
        before[1:], after[:-1] = x[:-1] * same, x[1:] * same
    return np.concatenate([x, before, after], axis=1)


def forward_backward(score: np.ndarray, doc: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (n, 2) of lines and summed pair marginals (2, 2). Chains run in step, one line of every open document at a time."""
    n = len(score)
    if not n:
        return np.zeros((0, 2)), np.zeros((2, 2))
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    length = np.diff(np.append(first, n))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    emit = np.exp(score - score.max(axis=1, keepdims=True))
    move = np.exp(trans - trans.max())
    alpha, beta, pairs = np.zeros((n, 2)), np.ones((n, 2)), np.zeros((2, 2))
    open_ = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")  # documents with more than t lines
    for t in range(length[0]):
        at = first[:open_[t]] + t
        a = emit[at] if t == 0 else (alpha[at - 1] @ move) * emit[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    for t in range(length[0] - 1, 0, -1):
        at = first[:open_[t]] + t
        right = emit[at] * beta[at]
        b = right @ move.T
        joint = alpha[at - 1][:, :, None] * move * right[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta[at - 1] = b / b.sum(axis=1, keepdims=True)
    marginal = alpha * beta
    return marginal / marginal.sum(axis=1, keepdims=True), pairs


@dataclass
class Field:
    weights: np.ndarray  # (features, 2)
    trans: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def quality(self, texts: list[str]) -> np.ndarray:
        """Length-weighted share of good lines per text; 0 for a text without a word."""
        x, size, doc = features_in_slices(texts)
        marginal, _ = forward_backward(with_neighbours(x, doc) @ self.weights, doc, self.trans)
        total = np.bincount(doc, weights=size, minlength=len(texts))
        good = np.bincount(doc, weights=size * marginal[:, 1], minlength=len(texts)) if len(doc) else np.zeros(len(texts))
        return good / np.maximum(total, 1)

    def scores(self, texts: list[str]) -> np.ndarray:
        q = np.clip(self.quality(texts), 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-(self.slope * np.log(q / (1 - q)) + self.shift)))


def train(texts: list[str], labels: np.ndarray, rounds: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> Field:
    """Maximum conditional likelihood by Adam over the sample; then a logistic calibration of document qualities."""
    x, size, doc = features_in_slices(texts)
    x = with_neighbours(x, doc)
    field = Field(np.zeros((x.shape[1], 2)), np.zeros((2, 2)))
    if not len(x):
        return field
    y = labels[doc].astype("int64")
    truth = np.eye(2)[y]
    inner = doc[1:] == doc[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][inner], y[1:][inner]), 1)
    # A long document weighs as much as a short one, and both classes weigh the same.
    lines = np.bincount(doc, minlength=len(texts)).astype("float64")
    params = [field.weights, field.trans]
    moment, spread = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = 1 / np.maximum(lines[doc], 1)
    weight *= np.where(y == 1, 0.5 / max((weight * (y == 1)).sum(), 1e-9), 0.5 / max((weight * (y == 0)).sum(), 1e-9))
    for step in range(1, rounds + 1):
        marginal, pairs = forward_backward(x @ field.weights, doc, field.trans)
        grads = [x.T @ ((truth - marginal) * weight[:, None]) - ridge * field.weights, (seen - pairs) / max(inner.sum(), 1) - ridge * field.trans]
        for i, g in enumerate(grads):
            moment[i] = 0.9 * moment[i] + 0.1 * g
            spread[i] = 0.999 * spread[i] + 0.001 * g * g
            params[i] += rate * (moment[i] / (1 - 0.9**step)) / (np.sqrt(spread[i] / (1 - 0.999**step)) + 1e-8)
    # Chains hardly ever change label in the sample: without this bound one line could not differ from its document.
    np.clip(field.trans, -1.0, 1.0, out=field.trans)
    q = np.clip(field.quality(texts), 1e-4, 1 - 1e-4)
    z = np.log(q / (1 - q))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a * z + b)))
        g, hess = labels - p, np.maximum(p * (1 - p), 1e-6)
        m = np.array([[(hess * z * z).sum() + 1.0, (hess * z).sum()], [(hess * z).sum(), hess.sum() + 1e-3]])
        da, db = np.linalg.solve(m, [(g * z).sum() - (a - 1.0), g.sum()])
        a, b = a + 0.5 * da, b + 0.5 * db
    field.slope, field.shift = float(max(a, 0.05)), float(b)
    return field


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_DOCS) -> Field:
    """The field learnt from at most about ``bound`` rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, y) covers.

    The sample is drawn by a hash of the id. Its line features are of fixed width; texts go through the driver only for these
    ``bound`` documents. Without any label the field is neutral and every text scores one half.
    """
    sample = bounded_sample(labels, "doc_id", bound, labels.count())
    rows = docs.where(F.col("doc_id").isNotNull()).join(sample, "doc_id").select("doc_id", whole().alias("text"), "y").toPandas()
    rows = rows.sort_values(["doc_id", "text"])
    return train(rows["text"].tolist(), rows["y"].to_numpy("float64")) if len(rows) else Field(np.zeros((3 * N_BASE, 2)), np.zeros((2, 2)))


def score(spark: SparkSession, docs: DataFrame, field: Field, threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` plus score and predicted (in place of such columns); one row per input row, whole texts, nulls as empty."""
    model = share(spark, field)
    docs = docs.drop("score", "predicted")
    names = docs.columns
    (held,) = free_names(names, "_text")
    body = whole().alias(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared(model)
        for batch in byte_slices(batches, held, 4 << 20):
            scores = known.scores(batch.column(held).to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(scores)], [*names, "score"])

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", score double"
    return docs.select("*", body).mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


HELD_OUT, FOLDS = 0, 5


def fitted(spark: SparkSession, sf_dir: str) -> Field:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fit(spark, docs, training_labels(table(spark, sf_dir, "labels"), "quality", FOLDS, HELD_OUT))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = (folded("doc_id", FOLDS) == HELD_OUT).alias("held_out")
    scored = score(spark, docs, fitted(spark, sf_dir))
    return scored.select("doc_id", held, "score", "predicted")
