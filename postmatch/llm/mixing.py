"""Mixing sources to target weights by cube-method balanced sampling.

A source whose target is r times its size gives floor(r) copies of every document and one more of a sample with inclusion
probability r - floor(r). The sample is drawn by the cube method: probabilities move along directions that keep the expected number of
documents and of words (the null space of the two balancing constraints over three documents) until each is 0 or 1. Blocks of a
source fly on their own; the at most two undecided documents of each block meet in larger blocks, and the
last dozen of a source lands on the choice nearest to the expected totals.
"""

from __future__ import annotations

from itertools import product
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stager, free_names, table, whole, words_of

WEIGHTS = (3.0, 1.0, 2.0)
#: Documents of a source that land together with the one or two that its last flight leaves: 2^12 choices at most.
LANDING = 10
#: A document this many times as long as the median is decided before the flights.
LONG = 10


def targets(sizes: dict[str | None, int], weights: tuple[float, ...], share: float, stop: float) -> dict[str | None, float]:
    """Water filling: budget by weight, no target above ``stop`` times its source, excess shared among the others."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, full, out = share * sum(sizes.values()), set(), {}
    while True:
        open_ = [s for s in names if s not in full]
        left = budget - sum(stop * sizes[s] for s in names if s in full)
        total = sum(weight[s] for s in open_)
        out = {s: stop * sizes[s] if s in full else left * weight[s] / total for s in names}
        above = {s for s in open_ if out[s] > stop * sizes[s]}
        if not above:
            return out
        full |= above


def flight(sizes: list[float], probs: list[float], random: Random) -> list[float]:
    """Moves probabilities until at most two (of different size) are strictly between 0 and 1; both totals stay."""
    probs, active, tiny = list(probs), [], 1e-9
    upcoming = iter([i for i, p in enumerate(probs) if tiny < p < 1 - tiny])
    while True:
        while len(active) < 3 and (i := next(upcoming, None)) is not None:
            active.append(i)
        if len(active) == 3:
            a, b, c = (sizes[i] for i in active)
            way = [b - c, c - a, a - b]
            if way == [0, 0, 0]:
                way = [1, -1, 0]
        elif len(active) == 2 and sizes[active[0]] == sizes[active[1]]:
            way = [1, -1]
        else:
            return probs
        up = down = float("inf")
        for i, u in zip(active, way, strict=True):
            if u > 0:
                up, down = min(up, (1 - probs[i]) / u), min(down, probs[i] / u)
            elif u < 0:
                up, down = min(up, probs[i] / -u), min(down, (1 - probs[i]) / -u)
        step = up if random.random() * (up + down) < down else -down
        for i, u in zip(active, way, strict=True):
            p = probs[i] + step * u
            probs[i] = 0.0 if p < tiny else 1.0 if p > 1 - tiny else p
        active = [i for i in active if 0 < probs[i] < 1]


def land(sizes: list[float], probs: list[float]) -> list[float]:
    """Decides the last few: the 0/1 choice whose words, then documents, are nearest to the expected ones."""
    open_ = [i for i, p in enumerate(probs) if 0 < p < 1]
    choices = np.array(list(product((0.0, 1.0), repeat=len(open_)))).reshape(2 ** len(open_), len(open_))
    words, prob = np.array([sizes[i] for i in open_]), np.array([probs[i] for i in open_])
    off = np.abs(choices @ words - prob @ words), np.abs(choices.sum(axis=1) - prob.sum())
    best = choices[np.lexsort((off[1], off[0].round(6)))[0]] if open_ else []
    out = list(probs)
    for i, x in zip(open_, best, strict=True):
        out[i] = float(x)
    return out


def settle(sizes: list[float], probs: list[float], random: Random) -> list[float]:
    """Decides the long documents, longest first; the others of the source absorb the words, each by the same change of its probability.

    What the others cannot absorb between 0 and 1 is left to the flight.
    """
    size, prob = np.array(sizes), np.array(probs)
    open_ = (prob > 0) & (prob < 1)
    if not open_.any():
        return list(probs)
    long = np.flatnonzero(open_ & (size > LONG * max(np.median(size[open_]), 1)))
    for i in long[np.argsort(-size[long], kind="stable")]:
        open_[i] = False
        others, up, down = prob[open_], 1 - prob[i], prob[i]
        words = size[open_].sum()
        if words and others.min() > up * size[i] / words and 1 - others.max() > down * size[i] / words:
            step = up if random.random() * (up + down) < down else -down
            prob[open_] -= step * size[i] / words
            prob[i] = float(step > 0)
        else:
            open_[i] = True
    return prob.tolist()


def fly(sizes: list[float], probs: list[float], random: Random, reserve: int) -> list[float]:
    """Long documents are settled and the others fly, all but ``reserve`` that stay undecided."""
    probs = settle(sizes, probs, random)
    held = [i for i, p in enumerate(probs) if 0 < p < 1][:reserve]
    kept = dict.fromkeys(held)
    rest = [i for i in range(len(probs)) if i not in kept]
    for i, p in zip(rest, flight([sizes[i] for i in rest], [probs[i] for i in rest], random), strict=True):
        probs[i] = p
    return probs


def finish(sizes: list[float], probs: list[float], random: Random) -> list[float]:
    """The last flight of a source: ``LANDING`` documents stay undecided and land with those the flight leaves."""
    return land(sizes, fly(sizes, probs, random, LANDING))


def _fly(level: int):
    def run(group, rows):
        sizes = rows["size"].to_numpy().astype("float64")
        order = np.lexsort((sizes, rows["_order"].to_numpy()))
        seed = f"{group[0].as_py()}/{group[1].as_py()}/{level}"
        probs = np.empty(len(order))
        blocks = rows["_blocks"][0].as_py()
        args = sizes[order].tolist(), rows["_prob"].to_numpy()[order].tolist(), Random(seed)
        # The blocks of a source together hold back what it lands with.
        probs[order] = finish(*args) if blocks == 1 else fly(*args, -(-LANDING // blocks))
        return rows.set_column(rows.column_names.index("_prob"), "_prob", pa.array(probs))

    return run


def mix(spark: SparkSession, rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, stop: float = 2.0,
        block_rows: int = 10_000) -> DataFrame:
    """``rows`` (key long, source, size) plus source_size, target, copies (int): one row per input row.

    Sources (null is one, last) are the configured list that has weights, so their totals fit the driver; rows never go there.
    Empty documents count as documents of size 0. Rows that repeat are drawn on their own; equal ones are interchangeable. Draws depend
    on the key, source and size alone, not on partitioning. An empty table gives an empty result.
    """
    stage = Stager(spark)
    rows = stage(rows, "sized")
    found = rows.groupBy("source").agg(F.sum("size"), F.count(F.lit(1))).collect()
    if not found:
        return rows.selectExpr("*", "0L AS source_size", "0D AS target", "0 AS copies")
    goal = targets({r[0]: r[1] for r in found}, weights, share, stop)
    plan = []
    for source, size, n in found:
        ratio = goal[source] / size if size else 0.0
        plan.append((source, size, goal[source], int(ratio), ratio - int(ratio), -(-n // block_rows)))
    known = spark.createDataFrame(plan, "_source string, source_size long, target double, _base int, _prob double, _blocks long")
    state = rows.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    state = state.withColumns({
        "_block": F.pmod(F.xxhash64("key", "source", "size"), F.col("_blocks")), "_order": F.xxhash64(F.lit("order"), "key", "size"),
    })
    columns = [f"{name} {kind}" for name, kind in state.dtypes]
    done, level = None, 0
    blocks = max(p[5] for p in plan)
    while True:
        last = blocks == 1

        # The key of a hot source is split by block; both sides of a block are bounded.
        moved = state.groupBy("source", "_block").applyInArrow(_fly(level), ", ".join(columns))
        moved = stage(moved, f"flown_{level}")
        part = moved.where("_prob IN (0, 1)")
        done = part if done is None else done.unionByName(part)
        if last:
            break
        # A source lands as soon as it has one block. Of many blocks, three rows each are left: block_rows / 4 of them meet in one.
        blocks, level = -(-blocks // (block_rows // 4)), level + 1
        state = moved.where("_prob NOT IN (0, 1)").withColumn("_blocks", F.ceil(F.col("_blocks") / (block_rows // 4)))
        state = state.withColumn("_block", F.pmod("_block", "_blocks"))
    return done.withColumn("copies", (F.col("_base") + F.col("_prob").cast("int"))).drop("_base", "_prob", "_blocks", "_block", "_order")


def sized(docs: DataFrame, key) -> DataFrame:
    return docs.select(key.cast("long").alias("key"), F.col("source").cast("string").alias("source"),
                       F.size(words_of(whole())).cast("long").alias("size"))


def mixed_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. ``docs`` is a stored table, read in the same order each time."""
    number, times, turn = free_names(docs.columns, "_row", "_copies", "_copy")
    row = F.monotonically_increasing_id()
    # The texts are shuffled at every size: a broadcast of the copies would have no bound.
    copies = mix(spark, sized(docs, row)).where("copies > 0").select(F.col("key").alias(number), F.col("copies").alias(times)).hint("merge")
    return docs.withColumn(number, row).join(copies, number).withColumn(
        turn, F.explode(F.sequence(F.lit(1), F.col(times)))
    ).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(spark, sized(docs, F.col("doc_id"))).select(
        F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )
