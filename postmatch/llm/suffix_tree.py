"""Scoring by a probabilistic suffix tree over words.

The tree has a head that every task holds and a rest that grows with the corpus. In the head are contexts of up to ``depth`` words that make
up at least ``context_share`` of all tokens, with symbols that follow them at least ``entry_share`` of all tokens, so both tables are bounded
by 1 / share whatever the corpus holds. All contexts of two and three words that are rarer than that are counted in buckets
(:mod:`.deep_contexts`) by absolute counts. A candidate stays in the tree if its distribution diverges from that of its suffix by more than
chance. What a distribution doesn't list is left to its suffix with the remaining weight; the root holds the counts of every word,
those too rare for the broadcast joined by shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import deep_contexts
from .common import Stager, byte_slices, folded, share, shared, table, whole
from .dictionary import tail_sums, word_counts

#: The end symbol; no word is empty. As a context it stands for the start of a text.
END = ""
HEAD_SHARE, CONTEXT_SHARE, ENTRY_SHARE = 5e-7, 1e-5, 2e-6
BUCKET_ROWS = 1_500_000
DISCOUNT = 0.75


class Ids(dict):
    """Word -> id; -1 for words outside the head."""

    def __missing__(self, word: bytes) -> int:
        return -1


@dataclass
class Level:
    """Contexts of one depth: sorted keys (parent context << 32 | word id) and, per context, what the tree needs."""

    keys: np.ndarray
    count: np.ndarray
    suffix: np.ndarray
    first: int = 0
    entries: np.ndarray = field(default_factory=lambda: np.zeros(0, "int64"))
    entry_count: np.ndarray = field(default_factory=lambda: np.zeros(0, "int64"))


def look_up(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions of ``wanted`` in sorted ``keys``, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1, "int64")
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def states(levels: list[Level], ids: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Per depth, the context (position in its level, or -1) in front of every token. ``starts``: first token of each text."""
    start = look_up(levels[0].keys, np.array([0]))[0] if levels else -1  # id 0 is the end symbol
    out: list[np.ndarray] = []
    for d, level in enumerate(levels):
        after = np.full(len(ids), -1, "int64")
        at = np.flatnonzero(ids >= 0 if d == 0 else (out[d - 1] >= 0) & (ids >= 0))
        after[at] = look_up(level.keys, ids[at] if d == 0 else (out[d - 1][at] << 32) | ids[at])
        before = np.empty_like(after)
        before[1:] = after[:-1]
        before[starts] = start if d == 0 else -1
        out.append(before)
    return out


def tokens(texts: list[str], ids: Ids) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words and end of each text, all ids in a row, and where each text starts."""
    words = [[*t.encode().lower().split(), b""] for t in texts]
    lengths = np.fromiter(map(len, words), "int64", len(words))
    flat = np.fromiter(map(ids.__getitem__, chain.from_iterable(words)), "int64", int(lengths.sum()))
    return words, flat, np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype("int64")


def _head_ids(head: list[bytes]) -> Ids:
    return Ids(zip(head, range(len(head)), strict=True))


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Per batch of coded texts: the batch, ids of all tokens, the same with -1 outside the head, where each text starts."""
    for batch in byte_slices(batches, "ids", 1 << 20):
        full, starts = deep_contexts.texts_from_bytes(batch.column("ids").to_pylist())
        yield batch, full, np.where(full < deep_contexts.RARE, full, -1), starts


def _count_entries(coded: DataFrame, levels: list[Level], symbols: int, held: int = 600_000) -> DataFrame:
    """(key, n): how often each symbol follows each context of the deepest level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(where, weights=np.concatenate([n for _, n in parts])).astype("int64")

        out = lambda keys, n: pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])
        for _, _, flat, starts in _coded(batches):
            state = states(levels, flat, starts)[-1]
            use = (state >= 0) & (flat >= 0) & (flat < symbols)
            parts.append(np.unique((state[use] << 32) | flat[use], return_counts=True))
            if sum(len(k) for k, _ in parts) > held:
                parts = [merged()]
                if len(parts[0][0]) > held // 2:
                    yield out(*parts[0])
                    parts = []
        if parts:
            yield out(*merged())

    return coded.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Tree:
    """Nodes 0 (root), then the contexts level by level. Tables are sorted by key = node << 32 | symbol."""

    levels: list[Level]
    kept: np.ndarray
    parent: np.ndarray
    log_rest: np.ndarray
    keys: np.ndarray
    log_p: np.ndarray
    log_root: np.ndarray

    def score(self, flat: np.ndarray, states: list[np.ndarray]) -> np.ndarray:
        """log10 probability of every token behind its context; for words outside the head without the root's part."""
        node = np.zeros(len(flat), "int64")
        for level, state in zip(self.levels, states, strict=False):
            at = np.where(state >= 0, level.first + state, 0)
            node = np.where((state >= 0) & self.kept[at], at, node)
        total, open_ = np.zeros(len(flat)), node > 0
        while open_.any():
            at = np.flatnonzero(open_)
            found = look_up(self.keys, np.where(flat[at] >= 0, (node[at] << 32) | flat[at], -1))
            hit = found >= 0
            total[at[hit]] += self.log_p[found[hit]]
            open_[at[hit]] = False
            node[at[hit]] = -1
            miss = at[~hit]
            total[miss] += self.log_rest[node[miss]]
            node[miss] = self.parent[node[miss]]
            open_[miss] = node[miss] > 0
        root = (node == 0) & (flat >= 0)
        total[root] += self.log_root[flat[root]]
        return total

    def behind(self, words: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of symbols behind two words, nearest first (1 for symbols outside the head), and whether the two are a context of the head."""
        inside = symbol < deep_contexts.RARE
        near, far = (look_up(self.levels[0].keys, w) if self.levels else np.full(len(w), -1) for w in words)
        both = look_up(self.levels[1].keys, np.where(far >= 0, (far << 32) | words[0], -1)) if len(self.levels) > 1 else np.full(len(near), -1)
        return np.where(inside, 10 ** self.score(np.where(inside, symbol, -1), [near, both]), 1.0), both >= 0


def build_tree(levels: list[Level], root: np.ndarray) -> Tree:
    """Divergence tests and smoothed distributions; ``root`` has the probability of every head word."""
    first = 1
    for level in levels:
        level.first, first = first, first + len(level.keys)
    kept, parent, rest = np.zeros(first, bool), np.zeros(first, "int64"), np.ones(first)
    kept[0] = True
    keys, probs = np.zeros(0, "int64"), np.zeros(0)

    def below(node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Probability of the symbol in the nearest kept node from ``node`` up."""
        node, scale, out, open_ = node.copy(), np.ones(len(node)), np.zeros(len(node)), np.ones(len(node), bool)
        while open_.any():
            at = np.flatnonzero(open_)
            found = np.where(node[at] > 0, look_up(keys, (node[at] << 32) | symbol[at]), -1)
            hit, top = found >= 0, node[at] == 0
            out[at[hit]] = scale[at[hit]] * probs[found[hit]]
            out[at[top]] = scale[at[top]] * root[symbol[at[top]]]
            open_[at[hit | top]] = False
            on = at[~(hit | top)]
            scale[on] *= rest[node[on]]
            node[on] = parent[node[on]]
        return out

    for d, level in enumerate(levels):
        nodes = level.first + np.arange(len(level.keys))
        above = np.where(level.suffix >= 0, levels[d - 1].first + level.suffix, 0) if d else np.zeros(len(nodes), "int64")
        # A context whose suffix was not kept hangs on the next kept one.
        parent[nodes] = np.where(kept[above], above, parent[above])
        ctx, symbol = level.entries >> 32, level.entries & 0xFFFFFFFF
        c, n = level.entry_count.astype(float), level.count.astype(float)
        rest[nodes] = np.maximum(1 - np.bincount(ctx, weights=(c - DISCOUNT) / n[ctx], minlength=len(nodes)), 1e-9)
        q = below(parent[nodes][ctx], symbol)
        p = c / n[ctx]
        listed_p, listed_q = (np.bincount(ctx, weights=w, minlength=len(nodes)) for w in (p, q))
        gain = np.bincount(ctx, weights=p * np.log(p / q), minlength=len(nodes))
        other_p, other_q = np.clip(1 - listed_p, 1e-12, 1), np.clip(1 - listed_q, 1e-12, 1)
        gain = n * (gain + other_p * np.log(other_p / other_q))
        free = np.bincount(ctx, minlength=len(nodes))
        kept[nodes] = (free > 0) & (2 * gain > free + 4 * np.sqrt(2 * free))
        use = kept[nodes][ctx]
        made = (c - DISCOUNT) / n[ctx] + rest[nodes][ctx] * q
        keys, probs = np.concatenate([keys, ((level.first + ctx) << 32 | symbol)[use]]), np.concatenate([probs, made[use]])
        order = np.argsort(keys)
        keys, probs = keys[order], probs[order]
    return Tree(levels, kept, parent, np.log10(rest), keys, np.log10(probs), np.log10(root))


def _through_buckets(coded: DataFrame, tree, buckets: int, stage: Stager) -> DataFrame:
    """(_row, gain): the score of each text to score, by the head and by what every bucket adds to the texts that it changes."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared(tree)
        for batch, full, flat, starts in _coded(batches):
            row, learn, score = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_row", "learn", "score"))
            at = states(model.levels, flat, starts)
            sums = np.add.reduceat(model.score(flat, at), starts)
            place, context = deep_contexts.before(full, starts)
            # What has a context of three words in the head stays there; where two words are in it, the three are looked at.
            known = at[1] >= 0 if len(at) > 1 else np.zeros(len(full), bool)
            deep = np.flatnonzero(np.where(known, (place > 1) & (at[2] < 0 if len(at) > 2 else True), place > 0))
            text = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(full))))[deep]
            mark = deep_contexts.marked(row, learn, score)[text]
            asked = [(-1 - int(row[0]), row[score].tobytes() + sums[score].tobytes())]
            asked += deep_contexts.packed(context[:, deep], full[deep], mark, buckets, known[deep])
            keys, blobs = zip(*asked, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def answer(key: tuple, blobs: pa.Table) -> pa.Table:
        parts = blobs.column("blob").to_pylist()
        if key[0].as_py() < 0:
            halves = [(np.frombuffer(p[:len(p) // 2], "int64"), np.frombuffer(p[len(p) // 2:], "float64")) for p in parts]
            found, gain = (np.concatenate(x) for x in zip(*halves, strict=True))
            found, gain = found[order := np.argsort(found)], gain[order]
        else:
            found, gain = deep_contexts.answers(parts, shared(tree).behind)
        keys, sums = zip(*deep_contexts.sums_by_block(found, gain), strict=True) if len(found) else ((), ())
        return pa.table({"block": pa.array(keys, pa.int64()), "blob": pa.array(sums, pa.binary())})

    def total(blobs: pa.Table) -> pa.Table:
        parts = [deep_contexts.sums_from_bytes(b) for b in blobs.column("blob").to_pylist()]
        found, where = np.unique(np.concatenate([r for r, _ in parts]), return_inverse=True)
        return pa.table({"_row": found, "gain": np.bincount(where, weights=np.concatenate([g for _, g in parts]), minlength=len(found))})

    asked = coded.select("_row", "learn", "score", "ids").mapInArrow(ask, "bucket long, blob binary")
    # Stored, so that the tokens in the buckets can be forgotten.
    answered = stage(asked.groupBy("bucket").applyInArrow(answer, "block long, blob binary"), "gains")
    return answered.groupBy("block").applyInArrow(total, "_row long, gain double")


def score_documents(spark: SparkSession, docs: DataFrame, training: DataFrame | None = None, depth: int = deep_contexts.DEEPEST,
                    head_share: float = HEAD_SHARE, context_share: float = CONTEXT_SHARE, entry_share: float = ENTRY_SHARE,
                    bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` (doc_id, text, held_out) scored by a tree that ``training`` (text) gives; one row per input row.

    Without ``training`` the rows of ``docs`` that are not held out teach. Null and empty texts hold the end symbol alone. Without training
    texts every token is unknown and has probability 1. ``depth`` is that of the head.
    """
    stage = Stager(spark)
    docs = docs.select("doc_id", whole().alias("text"), "held_out")
    learn = F.lit(False) if training is not None else ~F.coalesce("held_out", F.lit(True))
    rows = docs.select("*", learn.alias("learn"), F.lit(True).alias("score"))
    if training is None:
        training = rows.where("learn")
    else:
        taught = training.select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes if c != "text"], whole().alias("text"),
                                 F.lit(True).alias("learn"), F.lit(False).alias("score"))
        rows = rows.unionByName(taught)
    training = training.select(whole().alias("text"))
    buckets = max(1, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (6 * bucket_rows))

    def counter():
        def add(texts: list[str], counts: Counter) -> None:
            found = Counter("\n".join(texts).encode().lower().split())
            for word, n in found.items():
                counts[word.decode()] += n
            counts[END] += len(texts)
        return add

    words = stage(word_counts(training, counter), "words")
    n_all, v, once, twice = words.agg(F.sum("n"), F.count(F.lit(1)), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    n_all = n_all or 0
    d = once / (once + 2 * twice) if once and twice else 0.5
    least = max(2.0, head_share * n_all)
    top = words.where((F.col("n") >= least) & (F.col("word") != END)).toPandas().sort_values(["n", "word"], ascending=[False, True])
    ends = words.where(F.col("word") == END).agg(F.sum("n")).first()[0] or 0
    # The end symbol has id 0; without any training text there is no head.
    head_counts = np.concatenate([[ends], top["n"].to_numpy("int64")]) if n_all else np.zeros(0, "int64")
    head_words = spark.sparkContext.broadcast([b"", *[w.encode() for w in top["word"]]] if n_all else [])
    log_count = spark.sparkContext.broadcast(np.log10(head_counts + 1.0))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, logs = _head_ids(head_words.value), log_count.value
        for batch in byte_slices(batches, "text", 4 << 20):
            words, flat, starts = tokens(batch.column("text").to_pylist(), ids)
            known = flat >= 0
            base = np.zeros(len(flat))
            base[known] = logs[flat[known]]
            rest, ns, ends = [], [], [0]
            for ws, a, b in zip(words, starts, np.append(starts[1:], len(flat)), strict=True):
                tail = Counter(ws[i] for i in np.flatnonzero(~known[a:b]).tolist())
                rest.extend(tail.keys())
                ns.extend(tail.values())
                ends.append(len(rest))
            sums = [np.add.reduceat(x, starts) for x in (np.ones(len(flat), "int64"), known.astype("int64"), base)]
            tails = pa.StructArray.from_arrays([pa.array(rest, pa.binary()).cast(pa.string()), pa.array(ns, pa.int64())], ["w", "n"])
            coded = deep_contexts.texts_as_bytes(deep_contexts.word_ids(words, flat), starts)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], *map(pa.array, sums), pa.array(coded, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tails)],
                [*kept, "n_tokens", "head_known", "head_base", "ids", "tail"])

    kept, kind = ["_row", "doc_id", "held_out", "learn", "score"], dict(docs.dtypes)["doc_id"]
    coded = stage(rows.select(F.monotonically_increasing_id().alias("_row"), *kept[1:], "text").mapInArrow(
        encode, f"_row long, doc_id {kind}, held_out boolean, learn boolean, score boolean, n_tokens long, head_known long, "
                "head_base double, ids binary, tail array<struct<w:string,n:long>>"), "coded")
    levels: list[Level] = []
    if n_all:
        enough = np.flatnonzero(head_counts >= max(2.0, context_share * n_all))
        levels = [Level(enough.astype("int64"), head_counts[enough], np.full(len(enough), -1))]
        symbols = int((head_counts[1:] >= entry_share * n_all).sum()) + 1
        while True:
            level = levels[-1]
            counted = _count_entries(coded.where("learn").select("ids"), levels, symbols)
            found = counted.where(F.col("n") >= max(2.0, entry_share * n_all)).toPandas().sort_values("key")
            level.entries, level.entry_count = found["key"].to_numpy("int64"), found["n"].to_numpy("int64")
            deeper = (level.entry_count >= context_share * n_all) & (level.entries & 0xFFFFFFFF != 0)
            if len(levels) == depth or not deeper.any():
                break
            keys = level.entries[deeper]
            ctx, word = keys >> 32, keys & 0xFFFFFFFF
            if len(levels) == 1:
                suffix = look_up(level.keys, word)
            else:
                suffix = np.where(level.suffix[ctx] >= 0, look_up(level.keys, (level.suffix[ctx] << 32) | word), -1)
            levels.append(Level(keys, level.entry_count[deeper], suffix))
    tree = share(spark, build_tree(levels, np.maximum(head_counts - d, 1e-9) / n_all) if n_all else None)
    if n_all:
        gains = _through_buckets(coded, tree, buckets, stage)
    else:
        gains = coded.select("_row", F.lit(0.0).alias("gain"))
    rows = coded.where("score").drop("ids", "learn", "score")
    times, c = F.col("tail_n"), F.col("c")
    unknown = float(np.log10(d * v / n_all)) if n_all else 0.0
    known_word = F.log10(F.greatest(c - d, F.lit(1e-9))) - float(np.log10(max(n_all, 1)))
    summed = tail_sums(rows, words.select("word", F.col("n").alias("c")).where(F.col("word") != END), {
        "tail_known": F.when(c.isNotNull(), times).otherwise(0),
        "tail_base": times * F.when(c.isNotNull(), F.log10(c + 1.0)).otherwise(0.0),
        "tail_score": times * F.when(c.isNotNull(), known_word).otherwise(unknown),
    })
    log_all = float(np.log10(n_all + v + 1.0))
    return summed.join(gains, "_row").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.col("tail_known")).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.col("tail_base") - F.col("n_tokens") * log_all).alias("base_score"),
        (F.col("gain") + F.col("tail_score")).alias("score"),
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (folded("doc_id", 7) == 2).alias("held_out"))
    return score_documents(spark, docs)
