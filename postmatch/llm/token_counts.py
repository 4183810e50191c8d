"""Token counts without ids: pieces are counted once per distinct pre-token and joined to the pre-token frequencies of documents."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stager, byte_slices, table, whole
from .dictionary import tail_sums, word_counts
from .pretokens import PreTokens

#: Share of all pre-tokens from which one is broadcast: at most 2,000,000 entries, about 150,000 in natural text.
HEAD_SHARE = 5e-7


def token_counts(spark: SparkSession, docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
                 limit: int = 2048, head_share: float = HEAD_SHARE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; null text counts as empty, keys may be null or repeat."""
    docs = docs.select(F.col(key).alias("doc_id"), whole(text).alias("text"))
    stage = Stager(spark)

    def counter():
        pre = PreTokens(tokenizer)

        def add(texts: list[str], counts: Counter) -> None:
            for text in texts:
                counts.update(pre.counted(text))
        return add

    def piece_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = PreTokens(tokenizer)
        for batch in batches:
            pieces = pa.array([pre.pieces(w) for w in batch.column("word").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pieces], ["word", "n", "pieces"])

    words = stage(word_counts(docs.select("text"), counter).mapInArrow(piece_counts, "word string, n long, pieces long"), "pre_tokens")
    total = words.agg(F.sum("n")).first()[0] or 0
    head = dict(words.where(F.col("n") >= max(2.0, head_share * total)).select("word", "pieces").toPandas().itertuples(index=False, name=None))
    shared = spark.sparkContext.broadcast(head)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, known = PreTokens(tokenizer), shared.value
        for batch in byte_slices(batches, "text"):
            sums, words, ns, ends = [], [], [], [0]
            for body in batch.column("text").to_pylist():
                done = 0
                for p, n in pre.counted(body).items():
                    pieces = known.get(p)
                    if pieces is None:
                        words.append(p)
                        ns.append(n)
                    else:
                        done += n * pieces
                sums.append(done)
                ends.append(len(words))
            rest = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(ns, pa.int64())], ["w", "n"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("doc_id"), batch.column("n_bytes"), pa.array(sums, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)], ["_row", "doc_id", "n_bytes", "head", "tail"])

    keyed = docs.withColumns({"_row": F.monotonically_increasing_id(), "n_bytes": F.octet_length("text").cast("long")})
    kind = dict(docs.dtypes)["doc_id"]
    rows = stage(keyed.mapInArrow(
        frequencies, f"_row long, doc_id {kind}, n_bytes long, head long, tail array<struct<w:string,n:long>>"), "frequencies")
    summed = tail_sums(rows, words.select("word", "pieces"), {"rest": F.col("tail_n") * F.col("pieces")})
    n_tokens = (F.col("head") + F.col("rest")).alias("n_tokens")
    return summed.select("doc_id", "n_bytes", n_tokens).withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
