"""Clashing column names, vectors of unequal length, and the mix of whole tables with nulls, empty and very long texts."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np

from postmatch.llm import ann, mixing, quality_crf, quality_rules, shingle_sets
from postmatch.llm.common import Stager, free_names, table
from postmatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", "one", "the quick brown fox jumps over the lazy dog and then some more words follow", "a\nb\na\nb", "word " * 20_000]


def clashing(spark, *names):
    kinds = "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(i, t, "s", *[f"{n}{i}" for n in names]) for i, t in enumerate(TEXTS)], kinds)


def test_free_names():
    assert free_names(["_ROW", "_row_", "x"], "_row", "_copy", "_copy") == ["_row__", "_copy", "_copy_"]


def untouched(found, names):
    rows = found.collect()
    assert len(rows) and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
    return rows


def test_operators_leave_columns_of_their_inner_names_alone(spark):
    docs = clashing(spark, "_text", "y", "terms")
    field = quality_crf.Field(np.zeros((3 * quality_crf.N_BASE, 2)), np.zeros((2, 2)))
    assert len(untouched(quality_crf.score(spark, docs, field), ["_text", "y", "terms"])) == len(TEXTS)

    names = ["_words", "_lines", "_sorted"]
    rows = untouched(quality_rules.quality_rules(spark, clashing(spark, *names)), names)
    assert {r["doc_id"]: r["n_words"] for r in rows} == {i: len((t or "").split()) for i, t in enumerate(TEXTS)}

    names = ["_row", "_copy", "_copies", "copies"]
    docs = Stager(spark)(clashing(spark, *names).coalesce(1), "clashing")
    mixed = mixing.mixed_documents(spark, docs)
    assert mixed.columns == docs.columns
    untouched(mixed, names)
    first = shingle_sets.first_of_each(spark, docs)
    assert first.columns == docs.columns and {r["doc_id"] for r in untouched(first, names)} == {0, 2, 3, 4, 5}


def test_nearest_leaves_out_vectors_of_another_length(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(30)] + [(50, [1.0] * 9), (51, [2.0]), (52, []), (53, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.nearest(spark, frame, frame, 3).collect()
    assert {r["query_id"] for r in found} | {r["vec_id"] for r in found} == set(range(30)) and len(found) == 90


# --- 9 mixing: the query against its rules, worked out on their own ---

def water_filled(sizes):
    """Targets by bisection on the common level of words per weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(names, [3.0, 1.0, 2.0] * len(names), strict=False))
    goal, low, high = 1.5 * sum(sizes.values()), 0.0, 4.0 * sum(sizes.values()) + 1
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(level * weight[s], 2 * sizes[s]) for s in names) < goal else (low, level)
    return {s: min(high * weight[s], 2 * sizes[s]) for s in names}


def check_mix(rows, docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, size(t)) for i, t, _ in docs)
    totals, longest = Counter(), defaultdict(int)
    for _, t, s in docs:
        totals[s] += size(t)
        longest[s] = max(longest[s], size(t))
    goal, by_source = water_filled(totals), {}
    for s in totals:
        same = [r for r in rows if abs(r["target"] - goal[s]) < 1e-6 * max(goal[s], 1) and r["source_size"] == totals[s]]
        by_source[s] = same
        assert len(same) >= sum(x == s for _, _, x in docs)
    assert all(0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in rows)
    return totals, longest, goal, by_source


def test_mix_query_keeps_its_rules(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text", "source").collect()]
    rows = QUERIES["op9_mixing"](spark, SF).collect()
    totals, longest, goal, _ = check_mix(rows, docs)
    source = {i: s for i, _, s in docs}
    taken = Counter()
    for r in rows:
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= longest[s] / 2 + 1 for s in totals)
    assert sorted(map(tuple, QUERIES["op9_mixing"](spark, SF).collect())) == sorted(map(tuple, rows))


def test_mix_takes_odd_rows(spark):
    docs = [(i, "w " * (1 + i % 7), "a" if i % 3 else None) for i in range(120)]
    docs += [(None, "x y", "a"), (None, "x y", "a"), (5, docs[5][1], docs[5][2]), (200, None, "b"), (201, "", "b"), (202, "l " * 50_000, "c"), (203, " \n", "c"), (204, "one", "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(spark, mixing.sized(frame, frame["doc_id"])).withColumnRenamed("key", "doc_id").selectExpr(
        "doc_id", "size", "source_size", "target", "size * copies AS taken", "source").collect()
    totals, longest, goal, _ = check_mix(rows, docs)
    for s in totals:
        assert abs(sum(r["taken"] for r in rows if r["source"] == s) - goal[s]) <= longest[s] / 2 + 1
    assert mixing.mix(spark, mixing.sized(frame.where("false"), frame["doc_id"])).count() == 0
