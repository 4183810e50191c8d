"""The rare part of the suffix tree against a plain rebuild of its rules."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmatch.llm import deep_contexts as deep
from postmatch.llm import suffix_tree


def plain_gains(words, learn, p):
    """Token by token, one dictionary per depth."""
    rows, now = [tuple(w.tolist()) for w in words.T], p.tolist()
    stopped = [False] * len(rows)
    for depth in range(2, deep.DEEPEST + 1):
        counts, follow = Counter(), {}
        for i, r in enumerate(rows):
            stopped[i] |= deep.BEYOND in r[2:depth]
            if not stopped[i]:
                counts[r[:depth]] += int(learn[i])
                follow.setdefault(r[:depth], Counter())[r[deep.DEEPEST]] += int(learn[i])
        before = list(now)
        for i, r in enumerate(rows):
            context = r[:depth]
            n = counts[context]
            stopped[i] |= n < deep.LEAST
            if stopped[i]:
                continue
            listed = {s: c for s, c in follow[context].items() if c >= deep.LEAST and s < deep.RARE}
            if not listed:
                continue
            q = {s: before[next(j for j, o in enumerate(rows) if o[:depth] == context and o[deep.DEEPEST] == s)] for s in listed}
            left, left_q = (min(max(1 - x, 1e-12), 1) for x in (sum(listed.values()) / n, sum(q.values())))
            gain = n * (sum(c / n * math.log(c / n / q[s]) for s, c in listed.items()) + left * math.log(left / left_q))
            if 2 * gain > len(listed) + 4 * math.sqrt(2 * len(listed)):
                rest = max(1 - sum((c - deep.DISCOUNT) / n for c in listed.values()), 1e-9)
                now[i] = max(listed.get(r[deep.DEEPEST], 0) - deep.DISCOUNT, 0) / n + rest * before[i]
    return [math.log10(a / b) for a, b in zip(now, p.tolist(), strict=True)]


@pytest.mark.parametrize("seed", range(4))
def test_gains_equal_plain_rules(seed):
    rng = np.random.default_rng(seed)
    full = rng.integers(0, 4, 300)
    full[::17] += deep.RARE
    starts = np.array([0, 5, 6, 120])
    place, context = deep.before(full, starts)
    words = np.concatenate([context, full[None].astype("int32")])[:, place > 0]
    learn = rng.integers(0, 2, words.shape[1]).astype(float)
    start = np.array([[0.05, 0.02, 0.01, 0.03][s] for s in words[0] % 4]) * (1 + words[deep.DEEPEST] % 4)
    p = np.where(words[deep.DEEPEST] < deep.RARE, start, 1.0)
    got = deep.gains(words, learn, p)
    assert np.allclose(got, plain_gains(words, learn, p)) and (got != 0).any()


def test_packing_is_a_round_trip():
    rng = np.random.default_rng(1)
    context, symbol = rng.integers(0, deep.BEYOND, (deep.DEEPEST, 500), dtype="int32"), rng.integers(0, deep.BEYOND, 500)
    rows = np.sort(rng.integers(0, 1 << 40, 500))
    out = [deep.unpacked(b) for _, b in deep.packed(context, symbol, rows, 7)]
    got = sorted((*w, int(r)) for words, rs in out for w, r in zip(words.T.tolist(), rs, strict=True))
    assert got == sorted((*c, min(int(s), deep.RARE), int(r)) for c, s, r in zip(context.T.tolist(), symbol, rows, strict=True))


def test_tree_grows_and_tells_repeats_apart(spark):
    """A passage that occurs twice among many others is foreseen; buckets, slices and separate training rows change nothing."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.3, 120), 3000)) for _ in range(300)]
    texts += [texts[0], texts[1], "", None, "w1", "only once said " * 3]
    rows = [(i, t, i in (1, 7)) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3, "doc_id")

    def scored(*training, **options):
        return {r["doc_id"]: r for r in suffix_tree.score_documents(
            spark, frame, *training, context_share=1e-2, entry_share=1e-3, **options).collect()}

    one = scored()
    many, apart = scored(bucket_rows=500), scored(frame.where(~F.col("held_out")))
    assert len(one) == len(rows)
    for i, r in one.items():
        assert many[i]["score"] == pytest.approx(r["score"], abs=1e-6)
        assert apart[i]["score"] == pytest.approx(r["score"], abs=1e-6)
    rate = {i: one[i]["score"] / one[i]["n_tokens"] for i in range(302)}
    others = [v for i, v in rate.items() if i not in (0, 1, 300, 301)]
    assert min(rate[0], rate[300]) > max(others)
    # Text 1 is held out and its copy is learnt once: too little to be listed.
    assert rate[1] < np.quantile(others, 0.999)


def test_no_training_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "a b c d e", True), (None, None, None)], "doc_id long, text string, held_out boolean")
    assert all(r["score"] == 0 for r in suffix_tree.score_documents(spark, frame).collect())
    assert suffix_tree.score_documents(spark, frame.where("false")).count() == 0


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_three_words_count_behind_a_common_pair(spark, depth):
    """Behind a pair of the head the third word tells what follows; it tells so whatever the depth of the head."""
    texts = [f"k{i} p q r{i}" for i in range(50) for _ in range(4)]
    rows = [(i, t, False) for i, t in enumerate(texts)]
    rows += [(1000 + i, f"k{i} p q r{i}", True) for i in range(5)] + [(2000 + i, f"k{i} p q r{i + 7}", True) for i in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3, "doc_id")
    for options in ({}, {"bucket_rows": 20}):
        got = {r["doc_id"]: r["score"] for r in suffix_tree.score_documents(
            spark, frame, depth=depth, context_share=1e-2, entry_share=1e-3, **options).collect()}
        assert all(got[1000 + i] > got[2000 + i] + 1 for i in range(5))
