"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found with a block-max inverted index.

The index holds every term of a bounded sample of labelled documents; document frequencies cover all rows, and a text is compared over all of
its terms. A term counts by its TF-IDF weight, raised where its presence depends on the label. Examples lie in blocks; every term keeps its
postings and, per block, its largest weight. A query adds up these maxima to a bound per block, scores the blocks of highest bound, and then
those that can still reach its k-th best. Votes weighted by distance are calibrated on votes that the examples themselves get without their
own row, and the neighbours are the evidence.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, byte_slices, folded, share, shared, table, training_labels, whole
from .vectors import summed

#: Bound of what is learnt: labelled documents in the sample (on average).
SAMPLE_DOCS = 3_000
#: A term counts fully where chi-square of presence against label is far above ``HALF_CHI2`` (and a thirtieth of the examples), never below
#: ``LEAST_RELEVANCE``.
HALF_CHI2, LEAST_RELEVANCE = 30.0, 0.05
NEIGHBOURS, BLOCK = 25, 64
#: Blocks that are scored before bounds decide.
FIRST_BLOCKS = 6
#: A term of this share of the examples has a row of weights instead of postings; texts whose products with these rows are taken at a time.
COMMON, TEXTS_AT_ONCE = 0.04, 32
_SPACES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """Lower-cased runs of letters and digits (and of anything beyond ASCII)."""
    return text.lower().encode().translate(_SPACES).split()


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions of the ranges that begin at ``start``, one after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0, dtype="int32") + np.repeat((start - (ends - length)).astype("int32"), length)


@dataclass
class Index:
    """Examples in blocks of ``BLOCK``: postings by term and block, and the largest weight of each term in each block that has it.

    Terms that are common among the examples have rows of weights, by example, instead.
    """

    term_weight: np.ndarray
    doc_ids: np.ndarray
    labels: np.ndarray
    unseen_weight: float = 1.0
    base: float = 0.5
    slope: float = 1.0
    shift: float = 0.0
    row_of: np.ndarray = field(init=False)
    rows: np.ndarray = field(init=False)
    owner: np.ndarray = field(init=False)
    weight: np.ndarray = field(init=False)
    cell_of: np.ndarray = field(init=False)
    cell_block: np.ndarray = field(init=False)
    cell_top: np.ndarray = field(init=False)
    cell_start: np.ndarray = field(init=False)
    cell_size: np.ndarray = field(init=False)

    def vector(self, terms, tf, unseen=()) -> np.ndarray:
        """Unit weights of known ``terms``; the counts of ``unseen`` terms add to the length only."""
        w = (1 + np.log(np.asarray(tf, float))) * self.term_weight[np.asarray(terms, "int64")]
        rest = (1 + np.log(np.asarray(unseen, float))) * self.unseen_weight
        length = np.sqrt((w * w).sum() + (rest * rest).sum())
        return w / length if length > 0 else w

    def fill(self, rows: list[tuple[list[int], list[int]]]) -> None:
        size = [len(t) for t, _ in rows]
        term = np.concatenate([np.asarray(t, "int64") for t, _ in rows]) if sum(size) else np.zeros(0, "int64")
        owner = np.repeat(np.arange(len(rows)), size)
        weight = np.concatenate([self.vector(t, c) for t, c in rows if len(t)]) if sum(size) else np.zeros(0)
        common = np.bincount(term, minlength=len(self.term_weight)) >= max(COMMON * len(rows), 2)
        self.row_of = np.where(common, np.cumsum(common) - 1, -1)
        self.rows = np.zeros((int(common.sum()), len(rows)))
        self.rows[self.row_of[term[common[term]]], owner[common[term]]] = weight[common[term]]
        rare = ~common[term]
        term, owner, weight = term[rare], owner[rare], weight[rare]
        order = np.lexsort((owner, term))
        self.owner, self.weight, term = owner[order].astype("int32"), weight[order], term[order]
        block = self.owner // BLOCK
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        start = np.flatnonzero(new)
        # A cell is a term in a block: its postings, its block and its largest weight; cell_of says where the cells of a term begin.
        self.cell_start, self.cell_size = start, np.diff(np.append(start, len(term)))
        self.cell_block = block[start]
        self.cell_top = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0)
        self.cell_of = np.searchsorted(term[start], np.arange(len(self.term_weight) + 1))

    def common_part(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """(queries, examples): what the common terms add to the cosines of (terms, weights)."""
        dense = np.zeros((len(queries), len(self.rows)))
        for i, (terms, weights) in enumerate(queries):
            at = self.row_of[terms]
            dense[i, at[at >= 0]] = weights[at >= 0]
        return dense @ self.rows

    def nearest(self, terms, query: np.ndarray, k: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Exactly the k examples of largest cosine above 0 (ties: earlier example) and their cosines.

        ``common`` is the query's row of :meth:`common_part`. A block is bounded by the largest of these in it plus the largest weights of the
        other terms.
        """
        terms = np.asarray(terms, "int64")
        if common is None:
            common = self.common_part([(terms, query)])[0]
        rare = self.row_of[terms] < 0
        terms, query = terms[rare], query[rare]
        each = self.cell_of[terms + 1] - self.cell_of[terms]
        cells, heavy = _ranges(self.cell_of[terms], each), np.repeat(query, each)
        block = self.cell_block[cells]
        n = len(self.doc_ids)
        blocks = -(-n // BLOCK)
        bound = np.bincount(block, weights=heavy * self.cell_top[cells], minlength=blocks)
        if n:
            bound = bound + np.maximum.reduceat(common, np.arange(0, n, BLOCK))
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        ids, scores = np.zeros(0, "int64"), np.zeros(0)
        for now in (order[:FIRST_BLOCKS], order[FIRST_BLOCKS:]):
            if len(ids) == k:
                now = now[bound[now] >= scores[-1] - 1e-12]
            if not len(now):
                break
            wanted = np.zeros(blocks, bool)
            wanted[now] = True
            part = np.flatnonzero(wanted[block])
            length = self.cell_size[cells[part]]
            at = _ranges(self.cell_start[cells[part]], length)
            sums = common + np.bincount(self.owner[at], weights=np.repeat(heavy[part], length) * self.weight[at], minlength=n)
            hit = np.flatnonzero(np.repeat(wanted, BLOCK)[:n] & (sums > 0))
            ids, scores = np.concatenate([ids, hit]), np.concatenate([scores, sums[hit]])
            if len(ids) > k:
                good = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - 1e-11)
                ids, scores = ids[good], scores[good]
            best = np.lexsort((ids, -scores.round(12)))[:k]
            ids, scores = ids[best], scores[best]
        return ids, scores

    def vote(self, ids: np.ndarray, scores: np.ndarray) -> float:
        closeness = 1 / (1.05 - np.minimum(scores, 1))
        return float((closeness * self.labels[ids]).sum() / closeness.sum())

    def calibrated(self, vote: float) -> float:
        v = min(max(vote, 0.02), 0.98)
        return float(1 / (1 + np.exp(-(self.slope * np.log(v / (1 - v)) + self.shift))))

    def scores(self, texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> list[tuple[float, list[int], list[float]]]:
        """Score, evidence ids and their cosines for texts (known terms, their counts, counts of unseen terms), some at a time.

        A text that shares no term with any example takes the share of label 1.
        """
        out = []
        for a in range(0, len(texts), TEXTS_AT_ONCE):
            queries = [(terms, self.vector(terms, tf, unseen)) for terms, tf, unseen in texts[a:a + TEXTS_AT_ONCE]]
            for (terms, query), common in zip(queries, self.common_part(queries), strict=True):
                ids, cosines = self.nearest(terms, query, k, common) if len(terms) else (np.zeros(0, "int64"), np.zeros(0))
                if len(ids):
                    out.append((self.calibrated(self.vote(ids, cosines)), self.doc_ids[ids[:5]].tolist(), cosines[:5].tolist()))
                else:
                    out.append((self.base, [], []))
        return out


def build_index(examples: list[tuple[int, int, list[int], list[int]]], term_weight: np.ndarray, unseen_weight: float = 1.0, k: int = NEIGHBOURS) -> Index:
    """Index of (doc_id, y, terms, tf); examples with the same heavy terms side by side, so that block maxima are tight."""

    def heavy(e):
        w = (1 + np.log(np.asarray(e[3], float))) * term_weight[np.asarray(e[2], "int64")] if len(e[2]) else np.zeros(0)
        return [int(e[2][i]) for i in np.argsort(-w, kind="stable")[:8]], e[0]

    kept = sorted(examples, key=heavy)
    labels = np.array([e[1] for e in kept], float)
    index = Index(term_weight, np.array([e[0] for e in kept], "int64"), labels, unseen_weight, float((labels.sum() + 0.5) / (len(labels) + 1)))
    index.fill([(e[2], e[3]) for e in kept])
    votes, truth = [], []
    for i, (_, y, terms, tf) in enumerate(kept):
        if not len(terms):
            continue
        ids, cosines = index.nearest(terms, index.vector(terms, tf), k + 1)
        other = ids != i
        if other.any():
            votes.append(min(max(index.vote(ids[other], cosines[other]), 0.02), 0.98))
            truth.append(y)
    if votes and 0 < sum(truth) < len(truth):
        z, y = np.log(np.array(votes) / (1 - np.array(votes))), np.array(truth, float)
        a, b = 1.0, 0.0
        for _ in range(100):
            p = 1 / (1 + np.exp(-(a * z + b)))
            h = np.maximum(p * (1 - p), 1e-6)
            m = np.array([[(h * z * z).sum() + 1.0, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
            step = np.linalg.solve(m, [((y - p) * z).sum() - (a - 1.0), (y - p).sum()])
            a, b = a + 0.5 * step[0], b + 0.5 * step[1]
        index.slope, index.shift = float(max(a, 0.05)), float(b)
    return index


def example_terms(examples: DataFrame) -> DataFrame:
    """(doc_id, y, terms, tf) of examples (doc_id, y, text): all terms of the whole text in order of spelling, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text"):
            counts = [sorted(Counter(terms_of(t)).items()) for t in batch.column("text").to_pylist()]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "y": batch.column("y"),
                "terms": pa.array([[w for w, _ in c] for c in counts], pa.list_(pa.binary())), "tf": pa.array([[n for _, n in c] for c in counts], pa.list_(pa.int32())),
            })

    return examples.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, terms array<binary>, tf array<int>")


def relevance(present: np.ndarray, toxic: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """Factor of each term from the examples that have it (``present``, of which ``toxic`` have label 1): chi-square over itself plus a constant."""
    a, b, n = (present - toxic).astype(float), toxic.astype(float), float(n0 + n1)
    cross = a * (n1 - b) - b * (n0 - a)
    under = present * (n - present) * float(n0) * float(n1)
    chi2 = np.divide(n * cross * cross, under, out=np.zeros(len(a)), where=under > 0)
    return np.maximum(LEAST_RELEVANCE, chi2 / (chi2 + max(HALF_CHI2, n / 30)))


def document_frequencies(docs: DataFrame, words: list[bytes]) -> tuple[int, np.ndarray]:
    """(rows, rows that hold each word) over all rows of ``docs`` (text); each task counts on its own and sends one array."""

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        number = {w: i for i, w in enumerate(words)}
        counts = np.zeros(len(words) + 1, "int64")
        for batch in byte_slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                counts[[number[w] for w in set(terms_of(text)) if w in number]] += 1
            counts[-1] += batch.num_rows
        return counts

    counts = summed(docs.select("text"), part)
    return int(counts[-1]), counts[:-1]


def learn(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_DOCS) -> tuple[list[bytes], Index]:
    """(terms by number, index) from ``docs`` (doc_id, text) and ``labels`` (doc_id, y), of which about ``bound`` are drawn by a hash of the id.

    An id that several rows hold is one example, with the smallest of their texts.
    """
    sample = F.broadcast(bounded_sample(labels, "doc_id", bound, labels.count()))
    learnt = docs.where(F.col("doc_id").isNotNull()).join(sample, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = sorted(((r["doc_id"], r["y"], [bytes(w) for w in r["terms"]], list(r["tf"])) for r in example_terms(learnt).collect()), key=lambda r: r[0])
    words = sorted(set().union(*(r[2] for r in rows)))
    number = {w: i for i, w in enumerate(words)}
    examples = [(i, y, [number[w] for w in terms], tf) for i, y, terms, tf in rows]
    present, toxic = np.zeros(len(words), "int64"), np.zeros(len(words), "int64")
    for _, y, terms, _ in examples:
        present[terms] += 1
        toxic[terms] += y
    n, frequency = document_frequencies(docs, words)
    ones = sum(y for _, y, _, _ in examples)
    weight = (np.log((n + 1) / (frequency + 1)) + 1) * relevance(present, toxic, len(examples) - ones, ones)
    return words, build_index(examples, weight, float((np.log(n + 1) + 1) * LEAST_RELEVANCE))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_DOCS, threshold: float = 0.3) -> DataFrame:
    """``docs`` (doc_id, text, ...) without the text, plus score, predicted, evidence (doc ids) and cosines; one row per input row.

    ``labels`` (doc_id, y) has the rows to learn from, see :func:`learn`. A text is compared over all its terms with every example; terms that no
    example has count in its length as ones that no row has. Columns named like an added one are replaced. Nulls are empty texts. A text that
    shares no term with an example, and every text where there is none, takes the share of label 1 (one half without examples).
    """
    docs = docs.drop("score", "predicted", "evidence", "cosines").withColumn("text", whole())
    words, index = learn(docs, labels, bound)
    model, names = share(spark, (words, index)), [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled, examples = shared(model)
        number, known = {w: i for i, w in enumerate(spelled)}, {}
        for batch in byte_slices(batches, "text"):
            # Equal texts get equal scores, worked out once as long as they are remembered.
            texts = batch.column("text").to_pylist()
            keys = [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts]
            if len(known) > 100_000:
                known.clear()
            new = {key: t for key, t in zip(keys, texts, strict=True) if key not in known}
            asked = []
            for text in new.values():
                counts = Counter(terms_of(text))
                at = np.fromiter(map(number.get, counts, repeat(-1)), "int64", len(counts))
                tf = np.fromiter(counts.values(), "int64", len(counts))
                asked.append((at[at >= 0], tf[at >= 0], tf[at < 0]))
            known.update(zip(new, examples.scores(asked), strict=True))
            made = [known[key] for key in keys]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array([m[0] for m in made], pa.float64()), pa.array([m[1] for m in made], pa.list_(pa.int64())),
                 pa.array([m[2] for m in made], pa.list_(pa.float64()))], [*names, "score", "evidence", "cosines"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c in names) + ", score double, evidence array<long>, cosines array<double>"
    return docs.select(*names, "text").mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


HELD_OUT, FOLDS = 2, 4


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(spark, docs, training_labels(table(spark, sf_dir, "labels"), "toxic", FOLDS, HELD_OUT))
    return scored.select("doc_id", (folded("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted", "evidence", "cosines")
