"""SimHash near-duplicates by a generalised pigeonhole over unequal partitions.

Bits are grouped into partitions of correlated bits. If the thresholds t_i of m partitions add up to t - m + 1, two fingerprints within t bits
differ in at most t_i bits of some partition i. The thresholds (and m) are allocated by dynamic programming on estimated numbers
of probes and candidates. Every fingerprint is indexed under its bits of a partition and probes all values within t_i of them; found pairs
are verified on all 64 bits. Equal fingerprints are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stager, byte_slices, table, whole
from .components import connected_components

SHINGLE, SEED = 4, 42
#: Index rows of one key from which its pairs are searched in blocks, which give a spanning forest instead of all links.
HOT_KEY, BLOCK = 256, 4096
BUCKETS = 256
#: A probe is a row that is written, shuffled and sorted; a candidate pair is one comparison in a join that is there anyway.
PROBE_COST = 15.0


def shingle_hashes(text: str) -> list[int]:
    import xxhash

    words = text.encode().lower().split()
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return [xxhash.xxh64_intdigest(joined, SEED)] if words else []
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1, initial=0))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b - 1], SEED) for a, b in zip(ends, ends[SHINGLE:], strict=False)]


def majority_bits(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per run of ``lengths`` hashes, the bits set in over half of them; eight bits are counted at once in the bytes of a word."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype("int64")
    parts = -(-lengths // 255)
    first = np.concatenate([[0], np.cumsum(parts)[:-1]]).astype("int64")
    within = np.arange(int(parts.sum())) - np.repeat(first, parts)
    cuts = np.repeat(starts, parts) + 255 * within
    counts = np.zeros((len(lengths), 64), "int64")
    for k in range(8):
        lanes = (hashes >> np.uint64(k)) & np.uint64(0x0101010101010101)
        sums = np.add.reduceat(lanes, cuts).view("uint8").reshape(-1, 8).astype("int64")
        counts[:, k::8] = np.add.reduceat(sums, first, axis=0)
    return np.packbits(2 * counts > lengths[:, None], axis=1, bitorder="little").view("uint64").ravel()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(key, fp) from (key, text): fp holds the 64 bits as a long; a text without a word has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text", 4 << 20):
            found = [np.array(shingle_hashes(t), "uint64") for t in batch.column("text").to_pylist()]
            lengths = np.array([len(h) for h in found])
            out = np.zeros(len(found), "uint64")
            if (lengths > 0).any():
                out[lengths > 0] = majority_bits(np.concatenate(found), lengths[lengths > 0])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out.view("int64"))], ["key", "fp"])

    return docs.mapInArrow(run, "key long, fp long")


def _summed(df: DataFrame, f) -> dict[int, np.ndarray]:
    """Arrays of fixed number and length that tasks give, added up."""
    rows = df.mapInArrow(f, "id int, v array<long>").select("id", F.posexplode("v")).groupBy("id", "pos").agg(F.sum("col").alias("s"))
    out: dict[int, np.ndarray] = {}
    for name, part in rows.toPandas().sort_values(["id", "pos"]).groupby("id"):
        out[int(name)] = part["s"].to_numpy("int64")
    return out


def _rows(arrays: np.ndarray) -> pa.RecordBatch:
    values = pa.array(arrays.astype("int64").ravel())
    offsets = pa.array(np.arange(len(arrays) + 1, dtype="int32") * arrays.shape[1])
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(arrays), dtype="int32")), pa.ListArray.from_arrays(offsets, values)], ["id", "v"])


def bit_correlation(prints: DataFrame) -> np.ndarray:
    """Absolute correlation of every two bits over all fingerprints."""

    def run(batches):
        total = np.zeros((65, 64))
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view("uint64")
            bits = ((fp[:, None] >> np.arange(64, dtype="uint64")) & np.uint64(1)).astype("float64")
            total[:64] += bits.T @ bits
            total[64] += len(fp)
        yield _rows(total)

    sums = _summed(prints, run)
    if not sums:
        return np.zeros((64, 64))
    both = np.array([sums[i] for i in range(64)]) / max(sums[64][0], 1)
    p = np.diag(both)
    spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    return np.abs((both - np.outer(p, p)) / spread)


def partitions(correlation: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of near-equal width; each starts with its most correlated free pair and takes the bit nearest to it."""
    free, out = set(range(64)), []
    for i in range(m):
        width = 64 // m + (i < 64 % m)
        if width == len(free):
            out.append(sorted(free))
            break
        left = sorted(free)
        sub = correlation[np.ix_(left, left)] - 2 * np.eye(len(left))
        a, b = np.unravel_index(np.argmax(sub), sub.shape)
        group = [left[a], left[b]]
        while len(group) < width:
            rest = sorted(free - set(group))
            group.append(rest[int(np.argmax(correlation[np.ix_(rest, group)].mean(axis=1)))])
        out.append(sorted(group))
        free -= set(group)
    return out


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def estimated_pairs(prints: DataFrame, layouts: dict[int, list[list[int]]]) -> dict[int, list[tuple[float, float]]]:
    """Per partition of each layout: ordered pairs (self included) equal in it, and those that differ in one given bit, on average.

    Signed sums in ``BUCKETS`` buckets estimate the second moment of the values, with and without each bit; all fingerprints count.
    """
    masks: list[int] = []
    for parts in layouts.values():
        for bits in parts:
            masks += [_mask(bits), *[_mask(set(bits) - {b}) for b in bits]]

    def run(batches):
        sums = np.zeros((len(masks), BUCKETS))
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view("uint64")
            for i, mask in enumerate(masks):
                x = fp & np.uint64(mask)
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                sign = 1.0 - 2.0 * ((x >> np.uint64(40)) & np.uint64(1)).astype("float64")
                sums[i] += np.bincount((x >> np.uint64(56)).astype("int64"), weights=sign, minlength=BUCKETS)
        yield _rows(sums)

    found = _summed(prints, run)
    moment = [float((found[i].astype(float) ** 2).sum()) if found else 0.0 for i in range(len(masks))]
    out, at = {}, 0
    for m, parts in layouts.items():
        out[m] = []
        for bits in parts:
            same = moment[at]
            out[m].append((same, max(sum(moment[at + 1:at + 1 + len(bits)]) / len(bits) - same, 0.0)))
            at += 1 + len(bits)
    return out


def allocate(widths: list[int], pairs: list[tuple[float, float]], n: int, threshold: int, probe_cost: float = PROBE_COST) -> tuple[float, list[int]]:
    """Cheapest thresholds (-1: not probed) that add up to threshold - m + 1, by dynamic programming over the partitions."""

    def cost(i: int, t: int) -> float:
        if t < 0:
            return 0.0
        same, one = pairs[i]
        ratio = one / same if same else 0.0
        probes = n * sum(comb(widths[i], j) for j in range(t + 1))
        return probe_cost * probes + max(same * sum(comb(widths[i], j) * ratio**j for j in range(t + 1)) - n, 0.0)

    m = len(widths)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(m):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (so_far, chosen) in best.items():
            for t in range(-1, min(threshold, 3) + 1):
                option = (so_far + cost(i, t), [*chosen, t])
                if used + t + 1 not in step or option < step[used + t + 1]:
                    step[used + t + 1] = option
        best = step
    # Sum of (t_i + 1) has to be threshold + 1.
    return best[threshold + 1]


def plan_probes(prints: DataFrame, threshold: int) -> tuple[list[list[int]], list[int]]:
    correlation, n = bit_correlation(prints), prints.count()
    layouts = {m: partitions(correlation, m) for m in (2, 3, 4)}
    pairs = estimated_pairs(prints, layouts)
    choices = {m: allocate([len(b) for b in parts], pairs[m], n, threshold) for m, parts in layouts.items()}
    m = min(choices, key=lambda m: (choices[m][0], m))
    return layouts[m], choices[m][1]


def forest(values: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links values within ``threshold`` bits, found breadth first."""
    left, edges = values, []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= threshold
            if near.any():
                edges += [(int(at), int(x)) for x in left[near]]
                queue.extend(left[near])
                left = left[~near]
    return edges


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(spark: SparkSession, prints: DataFrame, threshold: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect exactly what is within ``threshold`` bits, step by step."""
    layout, chosen = plan_probes(prints, threshold)
    probes = []
    for part, (bits, t) in enumerate(zip(layout, chosen, strict=True)):
        for flips in (c for j in range(t + 1) for c in combinations(bits, j)):
            probes.append((part, _signed(_mask(bits)), _signed(_mask(flips))))
    probe = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(m).cast("long").alias("mask"), F.lit(x).cast("long").alias("flip")) for p, m, x in probes]))
    rows = prints.select("fp", probe.alias("p")).select(
        "fp", "p.part", F.col("fp").bitwiseAND(F.col("p.mask")).bitwiseXOR(F.col("p.flip")).alias("k"), (F.col("p.flip") == 0).alias("own")
    )
    index = [(p, m) for p, m, x in probes if x == 0]
    indexed = prints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(p).alias("part"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for p, m in index])).alias("p")).select("fp", "p.*")
    stage = Stager(spark)
    hot = stage(indexed.groupBy("part", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_KEY), "hot_keys")
    any_hot = not hot.isEmpty()
    cool = indexed.join(hot, ["part", "k"], "left_anti") if any_hot else indexed
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold
    found = rows.withColumnRenamed("fp", "b").join(cool.withColumnRenamed("fp", "a"), ["part", "k"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    if not any_hot:
        return found
    # A hot key: its rows in blocks, every two blocks (index with index, index with probes) together; each gives a forest.
    # Stored, as it is read twice: else every probe would be made once more.
    met = stage(rows.join(hot.select("part", "k"), ["part", "k"]), "hot_rows")
    sizes = met.groupBy("part", "k").agg(
        F.ceil(F.count_if("own") / BLOCK).alias("ni"), F.greatest(F.ceil(F.count_if(~F.col("own")) / BLOCK), F.lit(1)).alias("np"))
    placed = met.join(sizes, ["part", "k"]).withColumn(
        "at", F.pmod(F.xxhash64("fp"), F.when(F.col("own"), F.col("ni")).otherwise(F.col("np"))))
    others = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    pair: Column = F.when(F.col("own"), F.concat(
        F.transform(others("ni"), lambda j: F.struct(F.lit("i").alias("kind"), F.least("at", j).alias("x"), F.greatest("at", j).alias("y"))),
        F.transform(others("np"), lambda j: F.struct(F.lit("p").alias("kind"), F.col("at").alias("x"), j.alias("y"))),
    )).otherwise(F.transform(others("ni"), lambda j: F.struct(F.lit("p").alias("kind"), j.alias("x"), F.col("at").alias("y"))))

    def edges(t):
        found = np.array(forest(np.unique(t["fp"].to_numpy().view("uint64")), threshold), "uint64").reshape(-1, 2).view("int64")
        return pa.table({"a": found.min(axis=1), "b": found.max(axis=1)}) if len(found) else pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    blocks = placed.select("fp", "part", "k", F.explode(pair).alias("g")).select("fp", "part", "k", "g.*")
    return found.unionByName(blocks.groupBy("part", "k", "kind", "x", "y").applyInArrow(edges, "a long, b long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, threshold: int = 4) -> DataFrame:
    """(key, fp, component_id) of every row of ``docs`` (key long, text): the smallest key reachable by links of ``threshold`` bits.

    Null texts count as empty; texts without words share the fingerprint 0. Rows that repeat share all but the key.
    A group whose keys are all null has a null component.
    """
    stage = Stager(spark)
    marked = stage(fingerprints(docs), "fingerprints")
    prints = stage(marked.groupBy("fp").agg(F.min("key").alias("first")), "prints")
    found = connected_components(spark, links(spark, prints.select("fp"), threshold))
    roots = prints.join(found, prints.fp == found.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    named = roots.join(roots.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(named, "fp").select("key", "fp", "component_id")


def first_of_each(spark: SparkSession, docs: DataFrame, threshold: int = 4) -> DataFrame:
    """The first row, in the order of the stored table ``docs``, of every group of near-duplicates."""
    row = F.monotonically_increasing_id()
    groups = near_duplicates(spark, docs.select(row.alias("key"), whole().alias("text")), threshold)
    # The texts are shuffled at every size: a broadcast of the kept rows would have no bound.
    kept = groups.where("key = component_id").select(F.col("key").alias("_row")).hint("merge")
    return docs.withColumn("_row", row).join(kept, "_row", "left_semi").drop("_row")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), whole().alias("text"))
    return near_duplicates(spark, docs).select(
        F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
