"""What several operators share: tables, staging, label sets, tokenizer files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import Stager

#: Words of the contracts: runs of anything but these six ASCII blanks, the blanks of ``bytes.split()``.
BLANKS = r"[\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column has, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def folded(key: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id belongs to no fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds, F.lit(-1))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def training_labels(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """One row (doc_id, y) per labelled document outside the held-out fold.

    Rows without id or label teach nothing; of contradicting rows the majority counts, and 1 on a tie.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (folded("doc_id", folds) != held_out))
        .groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))
    )


def bounded_sample(rows: DataFrame, key: str, bound: int, n: int) -> DataFrame:
    """About ``bound`` of ``n`` rows, chosen by a hash of the key: the same rows on every run."""
    if n <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < int(bound / n * (1 << 30)))


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``limit`` bytes of ``column`` (one long text may exceed it)."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = size = 0
        for i, n in enumerate(sizes):
            if size and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < len(sizes):
            yield batch.slice(start)


def share(spark: SparkSession, model) -> Broadcast:
    """A model of bounded size for all tasks, with the code of its class, which executors need not have; see :func:`shared`."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def shared(broadcast: Broadcast):
    return cloudpickle.loads(broadcast.value)
