"""Hierarchical residual packing of tokenised documents into sequences.

Every partition packs its pieces best-fit locally and emits the bins that are nearly full. Underfull bins become items of the
next round, where a tree of groups packs them again. After best-fit at most one bin of a group is half full or less, and only such
a bin can still move into another one, so a group hands on its bins up to half full and its emptiest hosts; the rest is final.
No item is ever dropped: a bin that is not handed on is emitted as it is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stager, byte_slices, table, whole
from .pretokens import ChunkIds

PIECES_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECE = "struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>"
BINS_SCHEMA = f"fill long, done boolean, pieces array<{PIECE}>"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, key: str = "doc_id", text: str = "text",
                 with_ids: bool = False) -> DataFrame:
    """One row per piece: ids of each whole text and then ``end_id``, cut every ``capacity`` ids; optionally with the ids.

    A null text is empty: one piece that holds only the end id. Rows that repeat are encoded again. A null key stays null.
    """
    schema = PIECES_SCHEMA + (", ids array<long>" if with_ids else "")
    end, step = end_id.to_bytes(4, "little"), 4 * capacity

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ChunkIds(tokenizer)
        for batch in byte_slices(batches, "text"):
            out = [[] for _ in range(6)]
            for doc, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = chunks.text(body) + end
                for piece, at in enumerate(range(0, len(data), step)):
                    part = data[at:at + step]
                    row = (doc, piece, at // 4, len(part) // 4, zlib.crc32(part), memoryview(part).cast("I").tolist() if with_ids else None)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())][: 5 + with_ids]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), whole(text).alias("text")).mapInArrow(encode, schema)


def best_fit(items: list[tuple[int, list]], capacity: int) -> list[tuple[int, list]]:
    """Best-fit decreasing over (fill, pieces) items. A bit per residual tells which are open, so one step is a shift."""
    stacks: list[list[list]] = [[] for _ in range(capacity + 1)]
    used, bins = 0, []
    for fill, pieces in sorted(items, key=lambda x: -x[0]):
        fits = used >> fill
        if fits:
            left = fill + (fits & -fits).bit_length() - 1
            target = stacks[left].pop()
            if not stacks[left]:
                used &= ~(1 << left)
            target[1].extend(pieces)
            target[0] += fill
        else:
            target = [fill, list(pieces)]
            bins.append(target)
        left = capacity - target[0]
        stacks[left].append(target)
        used |= 1 << left
    return [(fill, pieces) for fill, pieces in bins]


def _marked(bins: list[tuple[int, list]], capacity: int, slack: int, hosts: int, last: bool) -> Iterator[tuple[int, bool, list]]:
    """Bins with a mark for those that are final."""
    ranked = sorted(bins, key=lambda b: b[0])
    for rank, (fill, pieces) in enumerate(ranked):
        yield fill, last or fill >= capacity - slack or not (2 * fill <= capacity or rank < hosts), pieces


def _arrow(rows: list[tuple[int, bool, list]]) -> pa.RecordBatch:
    names = ("doc_id", "piece", "start", "length", "ids_crc32", "offset")
    flat, ends = [[] for _ in names], [0]
    for _, _, pieces in rows:
        offset = 0
        for p in pieces:
            for column, value in zip(flat, (*p[:5], offset), strict=True):
                column.append(value)
            offset += p[3]
        ends.append(len(flat[0]))
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    structs = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(flat, kinds, strict=True)], list(names))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()),
         pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)], ["fill", "done", "pieces"])


def pack(spark: SparkSession, pieces: DataFrame, capacity: int, slack: int = 8, local_items: int = 50_000, hosts: int = 256) -> DataFrame:
    """Columns of the pieces plus sequence_id and offset; every piece once. ``pieces`` has the columns of :func:`token_pieces`.

    A task holds at most ``local_items`` pieces or bins at a time. Tied lengths are packed in the order they come in.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, list]] = []
        for batch in batches:
            for row in zip(*[batch.column(n).to_pylist() for n in names], strict=True):
                held.append((row[3], [row]))
                if len(held) == local_items:
                    yield _arrow(list(_marked(best_fit(held, capacity), capacity, slack, hosts, False)))
                    held = []
        if held:
            yield _arrow(list(_marked(best_fit(held, capacity), capacity, slack, hosts, False)))

    def merge(last: bool):
        def run(t):
            items = [(fill, [tuple(p.values()) for p in ps]) for fill, ps in zip(t["fill"].to_pylist(), t["pieces"].to_pylist(), strict=True)]
            return pa.Table.from_batches([_arrow(list(_marked(best_fit(items, capacity), capacity, slack, hosts, last)))])
        return run

    stage = Stager(spark)
    bins = stage(pieces.select(*names).mapInArrow(local, BINS_SCHEMA), "packed_0")
    final, level = bins.where("done"), 0
    while True:
        level += 1
        # The order of a stored table is fixed, so the groups are the same when a lost task runs again.
        rest = bins.where("NOT done").withColumn("_n", F.monotonically_increasing_id())
        n = rest.count()
        if n == 0:
            break
        groups = -(-n // local_items)
        grouped = rest.groupBy(F.pmod(F.xxhash64("_n"), F.lit(groups)).alias("_group"))
        bins = stage(grouped.applyInArrow(merge(groups == 1), BINS_SCHEMA), f"packed_{level}")
        final = final.unionByName(bins.where("done"))
        if groups == 1:
            break
    return final.withColumn("sequence_id", F.monotonically_increasing_id()).select("sequence_id", F.inline("pieces")).select(
        *names, "sequence_id", "offset"
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(spark, table(spark, sf_dir, "documents"))


def packed_documents(spark: SparkSession, docs: DataFrame, capacity: int = 2048) -> DataFrame:
    import public_tokenizers

    return pack(spark, token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity), capacity)
