"""Hard negatives by segment summaries.

The index stores, beside every vector, mean and deviation of each of its segments. For a segment of length l the inner product of two vectors
is l times the product of the means plus at most l times the product of the deviations, in size. Summed over coarse segments this bounds a
score; pairs whose bounds leave them a chance are bounded again over finer segments, and scored exactly at the end. Anchors travel to the
stored rows in blocks of bounded size, so no row of the table is shuffled for the search, and each task sends its best few per anchor.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stager, share, shared, table
from .vectors import finite, matrix_of, on_grid_rows, unpack, usual_length

SCALE = 256
#: Segments of the coarsest and the finest summary; the coarse ones are made of neighbouring fine ones.
COARSE, FINE = 4, 16
#: Anchors of a block, and rows and anchors that a task scores at a time.
ANCHOR_BLOCK, ROWS_AT_ONCE, ANCHORS_AT_ONCE = 65_536, 4_096, 512
#: Below this share of pairs in question, pairs are taken one by one and not as a whole matrix.
SPARSE = 0.15
NO_ID = np.iinfo("int64").max


def fine_ends(size: int, fine: int = FINE) -> np.ndarray:
    """Starts of the fine segments of vectors of ``size``, as even as possible."""
    fine = min(fine, size)
    return (np.arange(fine) * size) // fine


def summaries(x: np.ndarray, fine: int = FINE) -> tuple[np.ndarray, np.ndarray]:
    """(means, deviations) (rows, segments) of the fine segments."""
    starts = fine_ends(x.shape[1], fine)
    lengths = np.diff(np.append(starts, x.shape[1]))
    means = np.add.reduceat(x, starts, axis=1) / lengths
    apart = x - np.repeat(means, lengths, axis=1)
    return means, np.sqrt(np.add.reduceat(apart * apart, starts, axis=1) / lengths)


def weighed_levels(means: np.ndarray, deviations: np.ndarray, size: int, coarse: int = COARSE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Means and deviations times the root of the segment's length, for the coarse and the fine level: products of these are bounds.

    The deviation of a coarse segment follows from means and deviations of its parts.
    """
    fine = means.shape[1]
    lengths = np.diff(np.append(fine_ends(size, fine), size)).astype(float)
    levels = [(means * np.sqrt(lengths), deviations * np.sqrt(lengths))]
    if fine > coarse:
        starts = (np.arange(coarse) * fine) // coarse
        long = np.add.reduceat(lengths, starts)
        middle = np.add.reduceat(means * lengths, starts, axis=1) / long
        inside = np.add.reduceat((deviations ** 2 + means ** 2) * lengths, starts, axis=1) - middle ** 2 * long
        levels.insert(0, (middle * np.sqrt(long), np.sqrt(np.maximum(inside, 0))))
    return levels


@dataclass
class Vectors:
    """Rows of the index in memory, with the weighed levels of their summaries."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def read(cls, rows: pa.RecordBatch | pa.Table, size: int) -> Vectors:
        column = lambda name: c.combine_chunks() if isinstance(c := rows.column(name), pa.ChunkedArray) else c
        means, deviations = matrix_of(column("means")), matrix_of(column("deviations"))
        return cls(column("id").to_numpy(zero_copy_only=False), column("label").to_numpy(zero_copy_only=False), unpack(column("x"), size).astype(float),
                   weighed_levels(means, deviations, size))

    def take(self, rows) -> Vectors:
        return Vectors(self.ids[rows], self.labels[rows], self.x[rows], [(m[rows], d[rows]) for m, d in self.levels])


def promising(anchors: Vectors, rows: Vectors, alive: np.ndarray, least: np.ndarray, most: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor row, row, score) of the pairs of ``alive`` (anchors, rows) that can score within one of the anchor's windows.

    ``least`` and ``most`` (anchors, windows) are the ends of the windows. Every level refines only what the level before left.
    """
    pairs = None
    # Scores are integers; a quarter is far more than rounding, unless the vectors are huge.
    slack = 0.25 + 1e-12 * float(np.abs(anchors.x).max(initial=0.0)) * float(np.abs(rows.x).max(initial=0.0)) * anchors.x.shape[1]
    for a, c in zip(anchors.levels, rows.levels, strict=True):
        if pairs is None and alive.mean() >= SPARSE:
            middle, spread = a[0] @ c[0].T, a[1] @ c[1].T
            high, low = middle + spread + slack, middle - spread - slack
            fits = np.zeros(alive.shape, bool)
            for w in range(least.shape[1]):
                inside = high >= least[:, w, None]
                fits |= inside if most is None else inside & (low <= most[:, w, None])
            alive = alive & fits
        else:
            who, which = np.nonzero(alive) if pairs is None else pairs
            middle = np.einsum("ij,ij->i", a[0][who], c[0][which])
            spread = np.einsum("ij,ij->i", a[1][who], c[1][which])
            fits = np.zeros(len(who), bool)
            for w in range(least.shape[1]):
                inside = middle + spread + slack >= least[who, w]
                fits |= inside if most is None else inside & (middle - spread - slack <= most[who, w])
            pairs = who[fits], which[fits]
    if pairs is None and alive.mean() >= SPARSE:
        score = anchors.x @ rows.x.T
        who, which = np.nonzero(alive)
        return who, which, score[who, which]
    who, which = np.nonzero(alive) if pairs is None else pairs
    return who, which, np.einsum("ij,ij->i", anchors.x[who], rows.x[which])


class Best:
    """The best few (score, id) of every slot, higher scores first, ties by smaller id."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score, self.id = np.full((slots, k), -np.inf), np.full((slots, k), NO_ID)

    def offer(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        fine = score >= self.score[slot, -1]
        slot, score, ids = slot[fine], score[fine], ids[fine]
        if not len(slot):
            return
        touched = np.unique(slot)
        slot = np.concatenate([slot, np.repeat(touched, self.k)])
        score = np.concatenate([score, self.score[touched].ravel()])
        ids = np.concatenate([ids, self.id[touched].ravel()])
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.searchsorted(slot, touched)
        at = first[:, None] + np.arange(self.k)
        self.score[touched], self.id[touched] = score[at], ids[at]

    def filled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, at = np.nonzero(np.isfinite(self.score))
        return slot, self.score[slot, at], self.id[slot, at]


def build_index(spark: SparkSession, rows: DataFrame, key: str, vector: str, label: str, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(stored index (id, label, x, means, deviations), length of its vectors). Rows with a null id, label or vector, or null or non-finite
    entries, take no part, nor vectors of another length than most. Of rows that repeat an id the one with the smallest label and vector counts.
    """
    v = F.col(vector).cast("array<double>")
    named = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.alias("v"))
    named = named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))
    size = usual_length(named, "v")
    grid = on_grid_rows(named.where(F.size("v") == size), scale, ["id", "label"])
    once = grid.groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.label", "r.x")

    def summarise(batches):
        for b in batches:
            if b.num_rows:
                means, deviations = summaries(unpack(b.column("x"), size).astype(float))
                lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype="int32") * m.shape[1]), pa.array(m.ravel()))
                yield pa.record_batch({**{c: b.column(c) for c in ("id", "label", "x")}, "means": lists(means), "deviations": lists(deviations)})

    schema = "id long, label long, x binary, means array<double>, deviations array<double>"
    return Stager(spark)(once.mapInArrow(summarise, schema), "index"), size


def _scored(index: DataFrame, size: int, asked, windows: np.ndarray | None, same: bool, k: int) -> DataFrame:
    """(slot, score, other): the k best of each partition for every slot of the block of anchors.

    Without windows a slot is an anchor; with windows (anchors, w, 2), w slots belong to an anchor and hold scores within them.
    """
    per = 1 if windows is None else windows.shape[1]

    def run(batches):
        anchors: Vectors = shared(asked)
        best = Best(len(anchors.ids) * per, k)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                rows = Vectors.read(whole.slice(start, ROWS_AT_ONCE), size)
                groups = [(np.flatnonzero(anchors.labels == y), rows.take(np.flatnonzero(rows.labels == y))) for y in np.unique(rows.labels)] if same else [
                    (np.arange(len(anchors.ids)), rows)]
                for mine, against in groups:
                    for a in range(0, len(mine), ANCHORS_AT_ONCE):
                        at = mine[a:a + ANCHORS_AT_ONCE]
                        part = anchors.take(at)
                        slots = at[:, None] * per + np.arange(per)
                        least, most = best.score[slots, -1], None
                        if same:
                            alive = part.ids[:, None] != against.ids
                        else:
                            alive = part.labels[:, None] != against.labels
                            least, most = np.maximum(least, windows[at, :, 0]), windows[at, :, 1]
                        who, which, score = promising(part, against, alive, least, most)
                        for w in range(per):
                            ok = score >= least[who, w]
                            if most is not None:
                                ok &= score <= most[who, w]
                            best.offer(slots[who[ok], w], score[ok], against.ids[which[ok]])
        slot, score, ids = best.filled()
        yield pa.record_batch({"slot": pa.array(slot, pa.int64()), "score": pa.array(score.astype("int64")), "other": pa.array(ids)})

    found = index.mapInArrow(run, "slot long, score long, other long")
    rank = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    spark: SparkSession, rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows where ``anchors``, a condition on ``id``, holds.

    The positives of an anchor are its best ``positives`` other rows of the same label; the negatives of both are the best ``negatives`` rows
    of other labels with a score of ``low`` to ``high`` hundredths of the positive's. Scores are inner products of floor(scale * entry), exact
    below 2^53 and rounded to double precision above; ties go to the smaller id. Who takes part is told at :func:`build_index`; the search is
    exact. Anchors without positives, pairs without negatives and empty tables give no rows. Other columns are ignored.
    """
    stage = Stager(spark)
    index, size = build_index(spark, rows, key, vector, label, scale)
    chosen = index.where(anchors)
    blocks = -(-chosen.count() // anchor_block)
    found = spark.createDataFrame([], SCHEMA)
    for number in range(blocks):
        # A block of anchors has about ``anchor_block`` rows at every size of the table.
        block = chosen.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).orderBy("id").toArrow()
        asked = Vectors.read(block, size)
        if not len(asked.ids):
            continue
        sent = share(spark, asked)
        near = _scored(index, size, sent, None, True, positives).select("slot", F.col("rank").alias("p"), "score", "other").toArrow()
        slot, p, score = (near.column(c).to_numpy() for c in ("slot", "p", "score"))
        windows = np.full((len(asked.ids), positives, 2), np.nan)  # nan: no such positive, nothing fits
        windows[slot, p - 1, 0], windows[slot, p - 1, 1] = -(-low * score // 100), high * score // 100
        pairs = spark.createDataFrame(pa.table({
            "slot": slot * positives + p - 1, "anchor_id": asked.ids[slot], "positive_id": near.column("other"), "positive_score": score,
        }))
        far = _scored(index, size, sent, windows, False, negatives)
        block_found = pairs.join(far, "slot").select(
            "anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        found = found.unionByName(stage(block_found, f"block_{number}"))
    return found


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives(spark, rows, F.col("id") % 50 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), n AS (
  SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS place
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
  WHERE 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, place::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 3
"""
