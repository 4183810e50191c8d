"""What the operators on vectors share: usable rows, integer grids in narrow bytes, sums of partitions in two levels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Grid values are held to this size on either side; a double of this size has no fraction left.
GRID_LIMIT = 1 << 53
_WIDTHS = (1, 2, 4, 8)
#: Arrays of partitions that meet at a time.
FAN_IN = 16


def finite(vector: Column) -> Column:
    """Whether a vector is not null, not empty, and holds neither null nor non-finite entries."""
    entries = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & entries, F.lit(False))


def usual_length(rows: DataFrame, vector: str) -> int:
    """The length that most vectors have (the longer on a tie), 0 without rows."""
    found = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def matrix_of(column: pa.Array, dtype: str = "float64") -> np.ndarray:
    """(rows, d) of a list column whose lists are equally long."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def pack(grid: np.ndarray) -> list[bytes]:
    """Each row of integers in the narrowest width that holds it, so equal rows are equal bytes."""
    low, high = grid.min(axis=1), grid.max(axis=1)
    width = np.full(len(grid), 8)
    for w in (4, 2, 1):
        width[(low >= -(1 << (8 * w - 1))) & (high < 1 << (8 * w - 1))] = w
    out = [b""] * len(grid)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        data, step = grid[rows].astype(f"<i{w}").tobytes(), int(w) * grid.shape[1]
        for at, row in enumerate(rows.tolist()):
            out[row] = data[at * step:(at + 1) * step]
    return out


def unpack(packed: pa.Array, size: int) -> np.ndarray:
    """(rows, size) int64 of what :func:`pack` made."""
    values = packed.to_pylist()
    width = np.fromiter((len(v) // size for v in values), "int64", len(values))
    grid = np.empty((len(values), size), "int64")
    for w in _WIDTHS:
        rows = np.flatnonzero(width == w)
        if len(rows):
            grid[rows] = np.frombuffer(b"".join(values[r] for r in rows), f"<i{w}").reshape(-1, size)
    return grid


def on_grid_rows(rows: DataFrame, scale: int, keep: list[str]) -> DataFrame:
    """``keep`` and x of rows with a vector column v of equal lengths and finite entries: floor(scale * entry), packed."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                with np.errstate(over="ignore"):
                    grid = np.clip(np.floor(matrix_of(b.column("v")) * scale), -GRID_LIMIT, GRID_LIMIT).astype("int64")
                yield pa.record_batch({**{c: b.column(c) for c in keep}, "x": pa.array(pack(grid), pa.binary())})

    kinds = dict(rows.dtypes)
    return rows.select(*keep, "v").mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "x binary"]))


def summed(rows: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum of one array per partition of ``rows``; ``part`` makes it (float64 or int64) from the partition's batches.

    Arrays of many partitions meet ``FAN_IN`` at a time in a tree, so neither a task nor the driver holds more. The order of the sum is that of
    the partitions, whatever finishes first.
    """
    schema = "part int, kind string, shape array<int>, data binary"

    def row(at: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({
            "part": pa.array([at], pa.int32()), "kind": [total.dtype.str], "shape": pa.array([list(total.shape)], pa.list_(pa.int32())),
            "data": pa.array([np.ascontiguousarray(total).tobytes()], pa.binary()),
        })

    def array(kind: str, shape: list[int], data: bytes) -> np.ndarray:
        return np.frombuffer(data, kind).reshape(shape)

    def run(batches):
        total = part(batches)
        if total is not None:
            yield row(TaskContext.get().partitionId(), total)

    def meet(t: pa.Table) -> pa.Table:
        found = sorted(t.to_pylist(), key=lambda r: r["at"])
        total = sum((array(r["kind"], r["shape"], r["data"]) for r in found[1:]), array(found[0]["kind"], found[0]["shape"], found[0]["data"]))
        return pa.Table.from_batches([row(found[0]["part"], total)])

    parts = rows.rdd.getNumPartitions()
    sums = rows.mapInArrow(run, schema)
    while parts > FAN_IN:
        sums = sums.withColumns({"at": F.col("part"), "part": F.floor(F.col("part") / FAN_IN).cast("int")}).groupBy("part").applyInArrow(meet, schema)
        parts = -(-parts // FAN_IN)
    found = sorted(sums.collect(), key=lambda r: r["part"])
    if not found:  # no partition at all
        return part(iter(()))
    return sum((array(r["kind"], r["shape"], bytes(r["data"])) for r in found[1:]), array(found[0]["kind"], found[0]["shape"], bytes(found[0]["data"])))
