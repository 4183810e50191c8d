"""Whitening and hard negatives against numpy, brute force and the SQL twin, with nulls, ties, repeats, odd lengths and empty tables."""

from __future__ import annotations

import math
import os
import sys
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from postmatch.llm import hard_negatives as hn, vectors, whitening
from postmatch.llm.common import table
from postmatch.llm.queries import ORACLES, QUERIES

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
import compare as tool

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<double>, label int, x string, v int, component int, anchor_id long"


def made(spark, rows):
    return spark.createDataFrame([(i, v, y, "a", 1, 2, 3) for i, v, y in rows], KIND)


# --- shared helpers ---

def test_packed_rows_come_back():
    rng = np.random.default_rng(1)
    grid = np.concatenate([rng.integers(-(10 ** e), 10 ** e, (5, 3)) for e in (1, 2, 4, 9, 15)])
    grid[0] = [-128, 127, 0]
    grid[1] = [-129, 0, 0]
    import pyarrow as pa

    packed = vectors.pack(grid)
    assert [len(p) // 3 for p in packed[:2]] == [1, 2]
    assert (vectors.unpack(pa.array(packed, pa.binary()), 3) == grid).all()


def test_sums_of_many_partitions_meet_in_two_levels(spark):
    rows = spark.range(0, 1000, 1, 150).selectExpr("id AS x")
    total = vectors.summed(rows, lambda batches: np.array([[sum(pc.sum(b.column("x")).as_py() or 0 for b in batches), 1]], "int64"))
    assert total.tolist() == [[499500, 150]]


# --- 11 whitening ---

def matrices():
    rng = np.random.default_rng(5)
    for size in (1, 2, 7, 24, 90):
        a = rng.standard_normal((3 * size, size)) * np.linspace(3, 0.2, size)
        yield a.T @ a / size
    yield np.eye(40)
    yield np.zeros((5, 5))
    b = rng.standard_normal((60, 3))
    yield b @ b.T
    q, _ = np.linalg.qr(rng.standard_normal((80, 80)))
    yield q @ np.diag(np.repeat([9.0, 9.0, 4.0, 4.0, 1.0], 16)) @ q.T  # many equal eigenvalues


@pytest.mark.parametrize("matrix", list(matrices()), ids=lambda m: f"{len(m)}")
def test_eigenpairs_are_leading_and_at_double_precision(matrix):
    values, axes = whitening.leading_eigenpairs(lambda b: matrix @ b, len(matrix), 16)
    want = np.linalg.eigvalsh(matrix)[::-1][:16]
    scale = max(want[0], 1e-300)
    assert len(values) == min(16, len(matrix)) and np.allclose(values, want, rtol=0, atol=1e-12 * scale)
    assert np.abs(matrix @ axes - axes * values).max() <= 1e-12 * scale
    assert np.abs(axes.T @ axes - np.eye(len(values))).max() < 1e-12


def test_minres_solves_all_columns():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((25, 25))
    a, b = a + a.T, rng.standard_normal((25, 4))
    assert np.allclose(a @ whitening.minres(lambda x: a @ x, b, 60, 1e-13), b, atol=1e-9)
    assert not whitening.minres(lambda x: a @ x, np.zeros((25, 2)), 5).any()


def brute_whitened(rows):
    """(n, deviations, eigenvalues, axes, centred rows, trace) of rows of floats."""
    grid = [[math.floor(64 * c) + 1_000_000 for c in r] for r in rows]
    fit = sorted(set(map(tuple, grid)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    deviations = [sum((n * x - s) ** 2 for x, s in zip(r, sums, strict=True)) for r in grid]
    centre = lambda r: [float(Fraction(x) - Fraction(s, n)) for x, s in zip(r, sums, strict=True)]
    x = np.array([centre(r) for r in fit])
    values, axes = np.linalg.eigh(x.T @ x / n)
    return n, deviations, values[::-1], axes[:, ::-1], np.array([centre(r) for r in grid]), float((x * x).sum() / n)


def check_whitened(found, ids, rows):
    n, deviations, values, axes, centred, trace = brute_whitened(rows)
    k = min(16, int((values > 1e-10 * values[0]).sum()))
    assert Counter((r["vec_id"], r["deviation"], r["component"]) for r in found) == Counter(
        (i, d, c) for i, d in zip(ids, deviations, strict=True) for c in range(1, k + 1))
    by = list({(r["vec_id"], r["deviation"], r["component"]): r for r in sorted(found, key=lambda r: (r["vec_id"], r["deviation"], r["component"]))}.values())
    order = list({(ids[i], deviations[i]): i for i in sorted(range(len(rows)), key=lambda i: (ids[i], deviations[i]))}.values())
    assert {r["n"] for r in by} == {n} and all(r["identity_error"] < 1e-9 for r in by)
    got = np.array([r["whitened"] for r in by]).reshape(-1, k)
    want = (centred[order] @ axes[:, :k]) / np.sqrt(values[:k])
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got * sign - want).max() < 1e-6
    assert np.allclose([r["explained"] for r in by[:k]], values[:k] / trace, rtol=1e-9)


def test_whitening_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    check_whitened(QUERIES["op11_whitening"](spark, SF).collect(), [i for i, _ in rows], [v for _, v in rows])


def test_whitening_takes_odd_rows(spark):
    rng = np.random.default_rng(9)
    fine = [(i, rng.standard_normal(5).tolist(), 1) for i in range(40)]
    fine += [fine[3], fine[3], (7, rng.standard_normal(5).tolist(), None), (99, fine[5][1], 2)]
    odd = [(50, None, 1), (51, [1.0, None, 0.0, 0.0, 0.0], 1), (52, [math.nan] * 5, 1), (53, [math.inf, 0.0, 0.0, 0.0, 0.0], 1), (54, [1.0], 1), (55, [], 1)]
    found = whitening.whiten(spark, made(spark, fine + odd)).collect()
    check_whitened(found, [i for i, *_ in fine], [v for _, v, _ in fine])
    assert whitening.whiten(spark, made(spark, [(None, v, 1) for _, v, _ in fine])).where("vec_id IS NULL").count() == 5 * len(fine)


def test_whitening_without_variance_or_rows(spark):
    same = [(i, [0.5, 0.25], 1) for i in range(4)]
    assert whitening.whiten(spark, made(spark, same)).count() == 0
    assert whitening.whiten(spark, made(spark, [])).count() == 0
    assert whitening.whiten(spark, made(spark, [(1, None, 1)])).columns == [c.split()[0] for c in whitening.SCHEMA.split(", ")]
    flat = [(i, [float(i), float(i), 1.0], 1) for i in range(6)]  # one direction only
    assert {r["component"] for r in whitening.whiten(spark, made(spark, flat)).collect()} == {1}
    huge = [(i, [1e300 * (-1) ** i, 1.0], 1) for i in range(4)]
    assert whitening.whiten(spark, made(spark, huge)).where("deviation IS NULL").count() == 4


# --- 12 hard negatives ---

def brute_negatives(rows, chosen, positives=5, negatives=3, scale=256):
    """rows (id, vector, label) of usable rows with distinct ids."""
    grid = [(i, [math.floor(scale * c) for c in v], y) for i, v, y in rows]
    out = []
    for i, v, y in grid:
        if chosen(i):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, w, z in grid if j != i)
            for p, j in [(-s, j) for s, j, z in scored if z == y][:positives]:
                fit = [(j2, -s) for s, j2, z in scored if z != y and 50 * p <= -100 * s <= 95 * p][:negatives]
                out += [(i, j, rank + 1, j2, p, s) for rank, (j2, s) in enumerate(fit)]
    return sorted(out)


def test_bounds_hold_at_every_level():
    rng = np.random.default_rng(4)
    for size in (1, 3, 16, 19, 64):
        x, y = rng.integers(-60, 60, (30, size)).astype(float), rng.integers(-60, 60, (20, size)).astype(float)
        exact, widths = x @ y.T, []
        for (m, d), (n, e) in zip(hn.weighed_levels(*hn.summaries(x), size), hn.weighed_levels(*hn.summaries(y), size), strict=True):
            assert (exact <= m @ n.T + d @ e.T + 1e-6).all() and (exact >= m @ n.T - d @ e.T - 1e-6).all()
            widths.append((d @ e.T).sum())
        assert widths == sorted(widths, reverse=True)  # a finer level is never looser


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_hard_negatives_equal_their_twin(spark, scale):
    sf = f"/root/testdata/{scale}"
    assert tool.compare(spark, tool.connect(sf), "op12", QUERIES["op12_hard_negatives"], ORACLES["op12_hard_negatives"], sf) == ""


@pytest.mark.parametrize("sparse", [0.0, 0.15, 1.1])
def test_hard_negatives_with_ties_and_blocks(spark, sparse, monkeypatch):
    monkeypatch.setattr(hn, "SPARSE", sparse)
    rng = np.random.default_rng(6)
    pool = rng.integers(-3, 4, (25, 6)) / 4.0
    rows = [(i, pool[rng.integers(len(pool))].tolist(), int(rng.integers(3))) for i in range(240)]
    found = hn.hard_negatives(spark, made(spark, rows).repartition(5), F.col("id") % 4 == 0, anchor_block=17)
    assert sorted(map(tuple, found.collect())) == brute_negatives(rows, lambda i: i % 4 == 0)


def test_hard_negatives_take_odd_rows(spark):
    rows = [(i, [0.5 + i / 64, 0.25, -1.0], i % 2) for i in range(12)]
    odd = [(None, [1.0, 1.0, 1.0], 1), (20, None, 1), (21, [1.0, 1.0, 1.0], None), (22, [1.0, None, 1.0], 0), (24, [math.nan, 1.0, 1.0], 0), (26, [9.0, 9.0], 0)]
    again = [(2, [9.0, 9.0, 9.0], 1), rows[2], rows[4]]  # id 2 again with a larger label: the smallest counts
    found = hn.hard_negatives(spark, made(spark, rows + odd + again), F.col("id") % 2 == 0).collect()
    assert sorted(map(tuple, found)) == brute_negatives(rows, lambda i: i % 2 == 0) != []
    assert hn.hard_negatives(spark, made(spark, []), F.col("id") % 2 == 0).count() == 0
    assert hn.hard_negatives(spark, made(spark, rows), F.col("id") < 0).count() == 0
    assert hn.hard_negatives(spark, made(spark, [(0, [1.0], 1), (1, [1.0], 2)]), F.col("id") == 0).count() == 0
    assert found[0].asDict().keys() == {c.split()[0] for c in hn.SCHEMA.split(", ")}
