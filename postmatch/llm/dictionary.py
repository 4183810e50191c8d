"""Counts of all words of a corpus, split in a head with a proven bound and a tail that is joined by shuffle.

A word is in the head if it makes up at least a given share of all words, so the head has at most 1 / share entries whatever the corpus
holds; it is broadcast. Tail words are rare by definition, so a shuffle by word has no hot key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices

#: Distinct words a task holds before it hands on its partial counts.
HELD = 400_000


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
    )


def word_counts(texts: DataFrame, counter: Callable[[], Callable[[list[str], Counter], None]]) -> DataFrame:
    """(word, n) over all rows of ``texts`` (one column ``text``). ``counter()`` is made once per task and adds texts to a Counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, counts = counter(), Counter()
        for batch in byte_slices(batches, "text"):
            add(batch.column("text").to_pylist(), counts)
            if len(counts) > HELD:
                yield _counted(counts)
                counts = Counter()
        if counts:
            yield _counted(counts)

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def tail_sums(rows: DataFrame, words: DataFrame, sums: dict) -> DataFrame:
    """``rows`` (_row, tail array<struct<w,n>>) against ``words`` (word, ...): sums per row over its tail words, 0 without any.

    ``sums`` maps a name to an expression over tail_n and the columns of ``words`` (null where the word is unknown).
    """
    tail = rows.select("_row", F.inline("tail")).withColumnsRenamed({"w": "word", "n": "tail_n"})
    found = tail.join(words, "word", "left").groupBy("_row").agg(*[F.sum(e).alias(k) for k, e in sums.items()])
    return rows.drop("tail").join(found, "_row", "left").na.fill(0, list(sums))
