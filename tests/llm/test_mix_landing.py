"""Landing of the mix: long documents, and small sources beside a hot one."""

from __future__ import annotations

from collections import Counter
from random import Random

import numpy as np

from postmatch.llm import mixing


def test_longest_document_is_decided_and_absorbed():
    rng = np.random.default_rng(3)
    sizes = [*rng.integers(1, 900, 2000).astype(float).tolist(), 400_000.0]
    taken = 0
    for seed in range(40):
        flown = mixing.fly(sizes, [0.5] * len(sizes), Random(seed), 10)
        assert flown[-1] in (0, 1)
        taken += flown[-1]
        done = mixing.finish(sizes, [0.5] * len(sizes), Random(seed))
        assert set(done) <= {0, 1} and abs(np.dot(sizes, done) - sum(sizes) / 2) < 20
    assert 8 <= taken <= 32


def test_small_source_lands_the_same_beside_a_hot_one(spark):
    rng = np.random.default_rng(8)
    small = [(i, "small", int(n)) for i, n in enumerate(rng.integers(1, 900, 60))]
    hot = [(1000 + i, "hot", int(n)) for i, n in enumerate(rng.integers(1, 900, 700))]
    frame = spark.createDataFrame(small + hot, "key long, source string, size long")
    for weights in ((3.0, 1.0), (1.0, 1.0)):
        taken, goal = Counter(), {}
        for r in mixing.mix(spark, frame, weights=weights, share=0.1, block_rows=100).collect():
            taken[r["source"]] += r["size"] * r["copies"]
            goal[r["source"]] = r["target"]
        assert all(abs(taken[s] - goal[s]) <= 10 for s in goal)
