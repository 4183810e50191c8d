"""Positions within groups of unbounded size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 1 << 16


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows per group. Each task keeps at most ``n`` rows per group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def rank_by_level(df: DataFrame, group: str, level: str, tie: str, out: str = "rank",
                  chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Position in ``group`` by ``level`` descending, then by ``tie`` ascending.

    ``level`` takes few values (a score) and ``tie`` is a unique integer within the group. A group is cut
    into (level, block of ``tie`` values) pieces; rows are numbered inside their piece and shifted by
    the number of rows in the pieces before it. No task holds a whole group, and no row is dropped.
    """
    block = f"_{out}_block"
    piece = [group, level, block]
    cut = df.withColumn(block, F.floor(F.col(tie) / chunk_rows).cast("long"))
    earlier = Window.partitionBy(group).orderBy(F.desc(level), block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*piece)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*piece, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    local = F.row_number().over(Window.partitionBy(*piece).orderBy(tie))
    return (
        cut.join(offsets, piece)
        .withColumn(out, (F.col("_offset") + local).cast("int"))
        .drop(block, "_offset")
    )
