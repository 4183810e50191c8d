"""Nearest neighbours with robust-pruned directed graphs, one per shard.

Distinct vectors lie in shards of bounded size by a hash. A shard's graph starts random; every vector searches greedily for neighbours, and
relaxed distance pruning keeps a diverse set: a candidate goes if a kept one is nearer to it, by the factor alpha, than the vector itself.
The stored graphs are searched by beam, queries in blocks against every shard, and the best of all shards are merged. Inner products
become distances by one more coordinate that makes all vectors equally long. Vectors of a shard that a search reaches are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stager, table
from .vectors import usual_length

SHARD, QUERY_BLOCK = 8_192, 4_096
DEGREE, BEAM, ALPHA, ENTRIES = 32, 64, 1.2, 48
SEARCH_BEAM = 128


def _distances(points: np.ndarray, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances (B, K) of points[rows] (B, K) to ``to`` (B, d)."""
    diff = points[rows] - to[:, None, :]
    return np.einsum("bkd,bkd->bk", diff, diff)


def spread_rows(points: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` rows, each the farthest from those before it, from the one nearest to the mean: every far group gets one."""
    start = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    rows, left = [start], ((points - points[start]) ** 2).sum(axis=1)
    while len(rows) < min(count, len(points)):
        rows.append(int(left.argmax()))
        left = np.minimum(left, ((points - points[rows[-1]]) ** 2).sum(axis=1))
    return np.unique(rows)


def beam_search(points: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (B, beam) and distances, nearest first, -1 and inf beyond what was reached. All queries take a step at a time."""
    b, n = len(queries), len(points)
    rows, dist = np.full((b, beam), -1), np.full((b, beam), np.inf)
    begin = np.broadcast_to(entries, (b, len(entries)))
    first = _distances(points, begin, queries)
    order = np.argsort(first, axis=1, kind="stable")[:, :beam]
    rows[:, :order.shape[1]], dist[:, :order.shape[1]] = np.take_along_axis(begin, order, axis=1), np.take_along_axis(first, order, axis=1)
    opened, seen = np.zeros((b, beam), bool), np.zeros((b, n), bool)
    seen[:, entries] = True
    active = np.arange(b)
    while len(active):
        waiting = np.where(opened[active] | (rows[active] < 0), np.inf, dist[active])
        at = waiting.argmin(axis=1)
        more = np.isfinite(waiting[np.arange(len(active)), at])
        active, at = active[more], at[more]
        if not len(active):
            break
        opened[active, at] = True
        near = graph[rows[active, at]]
        fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
        d = np.where(fresh, _distances(points, np.maximum(near, 0), queries[active]), np.inf)
        who, which = np.nonzero(fresh)
        seen[active[who], near[who, which]] = True
        all_rows, all_dist = np.concatenate([rows[active], np.where(fresh, near, -1)], axis=1), np.concatenate([dist[active], d], axis=1)
        all_open = np.concatenate([opened[active], np.zeros_like(fresh)], axis=1)
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        take = lambda x: np.take_along_axis(x, order, axis=1)
        rows[active], dist[active], opened[active] = take(all_rows), take(all_dist), take(all_open)
    return rows, dist


def robust_prune(points: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each row in ``of`` from its candidates (B, C; -1 is none), nearest first."""
    valid = (candidates >= 0) & (candidates != of[:, None])
    order = np.argsort(np.where(valid, candidates, np.iinfo("int64").max), axis=1)
    candidates = np.take_along_axis(candidates, order, axis=1)
    valid = np.take_along_axis(valid, order, axis=1)
    valid[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    safe = np.maximum(candidates, 0)
    to_self = np.where(valid, _distances(points, safe, points[of]), np.inf)
    vectors = points[safe]
    square = np.einsum("bcd,bcd->bc", vectors, vectors)
    between = square[:, :, None] + square[:, None, :] - 2 * vectors @ vectors.transpose(0, 2, 1)
    out, every = np.full((len(of), degree), -1), np.arange(len(of))
    for slot in range(degree):
        best = to_self.argmin(axis=1)
        found = np.isfinite(to_self[every, best])
        if not found.any():
            break
        out[found, slot] = candidates[every, best][found]
        gone = alpha * alpha * between[every, best] <= to_self
        to_self[gone & found[:, None]] = np.inf
        to_self[every, best] = np.inf
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = 256, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours (n, degree), entry rows): two passes over all points, the first without relaxation."""
    n, random = len(points), np.random.default_rng(seed)
    graph = np.full((n, degree), -1)
    if n > 1:
        near = random.integers(0, n - 1, (n, min(degree, n - 1)))
        graph[:, :near.shape[1]] = near + (near >= np.arange(n)[:, None])
    entry = spread_rows(points, ENTRIES)
    for factor in (1.0, alpha):
        order = random.permutation(n)
        for start in range(0, n, batch):
            rows = order[start:start + batch]
            found, _ = beam_search(points, graph, entry, points[rows], beam)
            graph[rows] = robust_prune(points, rows, np.concatenate([found, graph[rows]], axis=1), degree, factor)
            # The new edges backwards; a full node is pruned again.
            source, target = np.repeat(rows, degree), graph[rows].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            nodes, first, count = np.unique(target, return_index=True, return_counts=True)
            width = int(count.max()) if len(count) else 0
            back = np.full((len(nodes), width), -1)
            back[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
            for a in range(0, len(nodes), batch):
                part = slice(a, a + batch)
                joined = np.concatenate([graph[nodes[part]], back[part]], axis=1)
                graph[nodes[part]] = robust_prune(points, nodes[part], joined, degree, factor)
    return graph, entry


def _matrix(column: pa.ChunkedArray | pa.Array, kind: str = "float64") -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(flat), -1)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): rows with an id and a vector of finite numbers that are not all zero."""
    v = F.col(vector).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.coalesce(fine.alias("f"), F.lit(False)))


def build_index(spark: SparkSession, rows: DataFrame, k: int, shard_rows: int = SHARD) -> DataFrame:
    """Stored graphs: (shard, node, entry, v, neighbours, ids). ``rows`` (id, v); equal vectors are one node with their k + 1 smallest ids,
    which is all that a list of k can need. Every usable row is indexed.
    """
    stage = Stager(spark)
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_rank") <= k + 1)
    nodes = stage(ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "nodes")
    found = nodes.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    n, longest = found[0], float(found[1] or 0.0)
    shards = max(1, -(-n // shard_rows))

    def graph(t):
        order = np.argsort([ids[0] for ids in t["ids"].to_pylist()], kind="stable")  # the same graph however rows arrive
        t = t.take(pa.array(order))
        v = _matrix(t["v"])
        lift = np.sqrt(np.maximum(longest - (v * v).sum(axis=1), 0))
        edges, entry = build_graph(np.concatenate([v, lift[:, None]], axis=1).astype("float32"))
        flat = pa.array(edges.astype("int32").ravel())
        neighbours = pa.ListArray.from_arrays(pa.array(np.arange(len(edges) + 1, dtype="int32") * edges.shape[1]), flat)
        return pa.table({
            "shard": t["shard"], "node": pa.array(np.arange(len(edges), dtype="int32")), "entry": pa.array(np.isin(np.arange(len(edges)), entry)),
            "v": t["v"], "neighbours": neighbours, "ids": t["ids"], "lift": pa.array(lift),
        })

    placed = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    schema = "shard int, node int, entry boolean, v array<double>, neighbours array<int>, ids array<long>, lift double"
    return stage(placed.groupBy("shard").applyInArrow(graph, schema), "graphs")


def search(spark: SparkSession, index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM, block_rows: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best by inner product that beam search finds in every shard, without the query's own id."""
    queries = Stager(spark)(queries, "queries")
    shards = [r[0] for r in index.select("shard").distinct().collect()]
    n = queries.count()
    if not shards or not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks = -(-n // block_rows)
    asked = queries.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).withColumn(
        "shard", F.explode(F.array(*[F.lit(s) for s in shards])))
    # A shard is read once for every block of queries; both sides of a group are bounded.
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def run(left, right):
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            order = np.argsort(left["node"].to_numpy())
            left = left.take(pa.array(order))
            v, q = _matrix(left["v"]), _matrix(right["v"])
            points = np.concatenate([v, left["lift"].to_numpy()[:, None]], axis=1).astype("float32")
            graph, ids = _matrix(left["neighbours"], "int64"), left["ids"].to_pylist()
            entry = np.flatnonzero(left["entry"].to_numpy())
            ask = right["id"].to_pylist()
            for a in range(0, len(q), 256):
                # Scaling a query keeps the order of its inner products; unit length balances it against the lifted points.
                unit = q[a:a + 256] / np.linalg.norm(q[a:a + 256], axis=1, keepdims=True) * max(np.sqrt((points[0] ** 2).sum()), 1e-12)
                near, _ = beam_search(points, graph, entry, np.pad(unit, ((0, 0), (0, 1))).astype("float32"), max(beam, k + 1))
                for i, rows in enumerate(near):
                    rows = rows[rows >= 0]
                    score = (v[rows] * q[a + i]).sum(axis=1)
                    best = sorted(((-s, x) for s, r in zip(score.tolist(), rows.tolist(), strict=True) for x in ids[r] if x != ask[a + i]))[:k]
                    out["query_id"] += [ask[a + i]] * len(best)
                    out["vec_id"] += [x for _, x in best]
                    out["score"] += [-s for s, _ in best]
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    grouped = held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
    found = grouped.applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each query's k nearest rows by inner product. Null ids, and vectors that are null, zero or not finite, take no part.

    Rows that repeat an id count once, with the smallest of its vectors. Vectors of another length than most of ``vectors`` take no part.
    """
    size = usual_length(usable(vectors, key, vector), "v")
    once = lambda df: usable(df, key, vector).where(F.size("v") == size).groupBy("id").agg(F.min("v").alias("v"))
    return search(spark, build_index(spark, once(vectors), k), once(queries), k)


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(spark, vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)
