"""The dealt operators against brute force, exact round trips and held-out accuracy, with nulls, empties, ties and repeats."""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from postmatch.llm import ann, chat, components, mixing, packing, quality_crf, quality_rules, simhash, suffix_tree, token_counts, toxicity
from postmatch.llm.common import table, training_labels
from postmatch.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: doc_id null, text null, empty, blank, one word, repeated rows, special strings, letters beyond the plain ones, a long text.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c"), (5, "a b c"), (None, "a b c d e f g"), (None, None),
    (6, "x<|endoftext|>Y <|ENDOFTEXT|> <|startoftext|>"), (7, "it's I'LL J̌ohn İstanbul ΣΑΣ ǰ\u0085y\x1cz"), (8, "😀😀 한글 ½ ² ﬁ Ⅷ"),
    (9, "word " * 30_000), (10, "The same line here again\n" * 9), (11, "#*$ %& <> | " * 20), (12, "a b \x00 c"),
]
KIND = "doc_id long, text string, source string, score int, _row int, key string"


def odd(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "s", 7, 1, "k") for i, t in rows], KIND)


def tokenizer_file():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("word_bpe_49k.json")


def encode():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file())
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]


def multiset(rows):
    return Counter(tuple(r) for r in rows)


# --- 1 toxicity ---

def test_nearest_is_exact():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(700):
        terms = sorted(rng.choice(40, rng.integers(1, 6), replace=False).tolist())
        rows.append((i, int(i % 9 == 0), terms, rng.integers(1, 5, len(terms)).tolist()))
    idf = rng.uniform(1, 4, 40)
    rows.append((700, 0, [], []))
    index = toxicity.build_index(rows, idf)
    dense = np.zeros((len(index.doc_ids), 40))
    by_id = {r[0]: r for r in rows}
    for n, i in enumerate(index.doc_ids.tolist()):
        dense[n, by_id[i][2]] = index.vector(np.array(by_id[i][2], int), by_id[i][3])
    for i in range(0, 700, 23):
        terms, tf = np.array(by_id[i][2]), by_id[i][3]
        query = index.vector(terms, tf)
        ids, scores = index.nearest(terms, query, 25)
        cosines = dense[:, terms] @ query
        want = np.lexsort((np.arange(len(cosines)), -cosines.round(12)))[:25]
        want = want[cosines[want] > 0]
        assert ids.tolist() == want.tolist() and np.allclose(scores, cosines[want])


def test_toxicity_learns_and_takes_odd_rows(spark):
    good = [(i, f"plain words number {i} of a calm text") for i in range(300)]
    bad = [(1000 + i, f"you are an awful nasty{'!' * (i % 3)} person number {i}") for i in range(60)]
    rows = odd(spark, good + bad + ODD)
    labels = spark.createDataFrame([(i, 0) for i, _ in good if i % 2] + [(i, 1) for i, _ in bad if i % 2], "doc_id long, y int")
    got = toxicity.toxicity(spark, rows, labels).collect()
    assert len(got) == len(good + bad + ODD) and all(0 <= r["score"] <= 1 for r in got)
    score = {r["doc_id"]: r["predicted"] for r in got}
    assert all(score[i] for i, _ in bad) and not any(score[i] for i, _ in good if i > 20)
    none = toxicity.toxicity(spark, rows, labels.where("false")).collect()
    assert len(none) == len(got)
    assert toxicity.toxicity(spark, rows.where("false"), labels).count() == 0


# --- 2 SimHash ---

def brute_print(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def brute_components(prints, threshold=4):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= threshold:
            root[find(b)] = find(a)
    return {p: find(p) for p in root}


@pytest.mark.parametrize("hot", [False, True])
def test_simhash_equals_brute_force(spark, docs, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(simhash, "HOT_KEY", 2)
        monkeypatch.setattr(simhash, "BLOCK", 4)
    near = [(20_000 + i, " ".join(f"w{k}" for k in range(400)) + f" end{i}") for i in range(30)]
    rows = [*docs, *near, *[r for r in ODD if r[0] is None or r[0] < 9]]
    rows = [(None if i is None else i + 50_000 if (i, t) in ODD else i, t) for i, t in rows]
    got = simhash.near_duplicates(spark, odd(spark, rows).select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))).collect()
    prints = [brute_print(t) for _, t in rows]
    root = brute_components(prints)
    first = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            first[root[p]] = min(first.get(root[p], i), i)
    want = Counter((i, p - (1 << 64) if p >> 63 else p, first.get(root[p])) for (i, _), p in zip(rows, prints, strict=True))
    assert Counter((r["key"], r["fp"], r["component_id"]) for r in got) == want


def test_allocation_keeps_the_pigeonhole(spark):
    for m, threshold in itertools.product((2, 3, 4), (0, 1, 4, 6)):
        cost, chosen = simhash.allocate([64 // m] * m, [(100.0, 20.0)] * m, 100, threshold) if threshold + 1 <= 4 * m else (0, None)
        assert chosen is None or sum(t + 1 for t in chosen) == threshold + 1
    layout = simhash.partitions(np.eye(64), 3)
    assert sorted(b for part in layout for b in part) == list(range(64))


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [tuple(map(int, e)) for e in rng.integers(200, 400, (90, 2))]
    got = {r["node"]: r["component"] for r in components.connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x in got} and {x for a, b in edges if a != b for x in (a, b)} == set(got)
    assert components.connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


# --- 3 token counts, 10 packing ---

def test_token_counts_equal_the_library(spark, docs):
    ids, rows = encode(), docs + ODD
    for share in (token_counts.HEAD_SHARE, 1e-3):
        got = token_counts.token_counts(spark, odd(spark, rows), tokenizer_file(), head_share=share).collect()
        assert multiset(got) == Counter((i, len((t or "").encode()), n := len(ids(t)), n > 2048) for i, t in rows)
    assert token_counts.token_counts(spark, odd(spark, []), tokenizer_file()).count() == 0


def test_packing_holds_every_piece(spark, docs):
    ids, rows, cap = encode(), docs + ODD, 2048
    got = packing.packed_documents(spark, odd(spark, rows)).collect()
    want = Counter()
    for i, t in rows:
        found = [*ids(t), 0]
        for piece, at in enumerate(range(0, len(found), cap)):
            part = found[at:at + cap]
            want[i, piece, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= cap
    assert len(bins) <= 1.02 * -(-sum(r["length"] for r in got) // cap) + 1
    assert packing.packed_documents(spark, odd(spark, [])).count() == 0


def test_packing_in_several_rounds(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, 0, int(n), i) for i, n in enumerate(rng.integers(1, 2049, 3000))]
    pieces = spark.createDataFrame(rows, packing.PIECES_SCHEMA)
    got = packing.pack(spark, pieces, 2048, local_items=100, hosts=8).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3000))
    fill = Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= 1.05 * sum(fill.values()) / 2048


# --- 4 quality field, 5 rules ---

def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    score, trans, doc = rng.normal(size=(5, 2)), rng.normal(size=(2, 2)), np.array([0, 0, 0, 1, 1])
    got, pairs = quality_crf.forward_backward(score, doc, trans)
    want, both = np.zeros((5, 2)), np.zeros((2, 2))
    for rows in ([0, 1, 2], [3, 4]):
        total, part, step = 0.0, np.zeros((5, 2)), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=len(rows)):
            w = math.exp(sum(score[r, y] for r, y in zip(rows, labels, strict=True)) + sum(trans[a, b] for a, b in itertools.pairwise(labels)))
            total += w
            for r, y in zip(rows, labels, strict=True):
                part[r, y] += w
            for a, b in itertools.pairwise(labels):
                step[a, b] += w
        want, both = want + part / total, both + step / total
    assert np.allclose(got, want) and np.allclose(pairs, both)


def test_quality_on_held_out_rows(spark):
    scored = quality_crf.op4_quality_classifier(spark, "/root/testdata/sf0.01").where("held_out")
    rows = scored.join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


def test_quality_takes_odd_rows(spark):
    rows = odd(spark)
    labels = spark.createDataFrame([(4, 1), (5, 1), (10, 0), (11, 0)], "doc_id long, y int")
    for known in (labels, labels.where("false")):
        got = quality_crf.score(spark, rows.drop("score"), quality_crf.fit(spark, rows, known)).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert quality_crf.score(spark, rows.where("false").drop("score"), quality_crf.fit(spark, rows, labels)).count() == 0


def brute_rules(text):
    text = text or ""
    words = [w for w in text.encode().split()]
    n, seen, covered = len(words), defaultdict(list), set()
    for i in range(n - 4):
        seen[tuple(words[i:i + 5])].append(i)
    for places in seen.values():
        if len(places) > 1:
            covered |= {i + k for i in places for k in range(5)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (n, sum(len(w.decode()) for w in words), sum(c in quality_rules.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


def test_rules_equal_brute_force(spark, docs):
    rows = docs + ODD
    judged = quality_rules.quality_rules(spark, odd(spark, rows))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert multiset(judged.select(*names).collect()) == Counter((i, *brute_rules(t)) for i, t in rows)
    # A filter on the verdict has the rows that the verdict names, and the order of the rules leaves it as it is.
    assert judged.where("kept").count() == sum(r["kept"] for r in judged.select("kept").collect())
    stats, conditions = quality_rules.base_stats(odd(spark, rows)), quality_rules.rules()
    kept = [quality_rules.apply_cascade(stats, conditions, order).where("kept").count() for order in (sorted(conditions), sorted(conditions, reverse=True))]
    assert kept[0] == kept[1] == judged.where("kept").count()
    assert quality_rules.quality_rules(spark, odd(spark, [])).count() == 0


# --- 6 chat ---

TURNS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi </turn> ### User: x"), (1, 2, "assistant", "\\1 ###"), (2, None, None, None), (2, 0, "assistant", ""),
    (3, 0, "user", "dup"), (3, 0, "user", "dup"), (None, 0, "assistant", "no id"), (4, 0, "a: b", "odd role: yes"), (5, 0, "assistant", "w " * 5000),
    *[(6, i, ("user", "assistant")[i % 2], f"turn {i} " + "word " * (i * 7 % 60)) for i in range(120)],
]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    windows = chat.chat_windows(rows, budget=200, history=40)
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    convs = defaultdict(list)
    for c, t, role, text in TURNS:
        convs[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (
            len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    spans = windows.where("conv_id = 6").collect()
    assert len(spans) > 5 and any(r["n_repeated"] for r in spans)
    assert all(len(r["formatted"].split()) <= 200 for r in spans)
    one = windows.where("conv_id = 1").collect()
    assert len(one) == 1 and one[0]["formatted"].startswith("### system: be brief</turn>\n")
    assert chat.read_back(chat.chat_windows(rows.where("false"))).count() == 0


def test_every_window_has_the_system_turn(spark):
    rows = spark.createDataFrame([(1, 0, "system", "rules"), *[(1, i, "assistant", "word " * 30) for i in range(1, 40)]], "conv_id long, turn long, role string, text string")
    windows = chat.chat_windows(rows, budget=160, history=40).collect()
    assert len(windows) > 3 and all(r["formatted"].startswith("### system: rules</turn>\n") for r in windows)
    assert sum(len(r["loss_mask"]) for r in windows) == 39


# --- 7 neighbours ---

def test_neighbours_recall_and_scores(spark):
    rows = table(spark, SF, "embeddings").select("vec_id", "embedding").collect()
    v, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    got = defaultdict(list)
    for r in ann.op7_nearest_neighbours(spark, SF).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        score = v @ v[ids == q][0]
        want = [int(ids[i]) for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        assert len(got[q]) == 20 and np.allclose([s for _, s in got[q]], [score[ids == i][0] for i, _ in got[q]])
        hits, total = hits + len(set(want) & {i for i, _ in got[q]}), total + 20
    assert hits / total >= 0.9


def test_neighbours_of_odd_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(100, 160)] + [(1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (None, [1.0, 1.0]),
            (5, [0.0, 2.0]), (5, [0.0, 2.0]), (6, [3.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in ann.nearest(spark, vectors, vectors.where("vec_id IN (1, 5, 100)"), 20).orderBy("query_id", "rank").collect()]
    assert [r[2] for r in got if r[0] == 100] == [6, *range(101, 120)]
    assert len([r for r in got if r[0] == 5]) == 20 and not [r for r in got if r[0] == 1]
    assert ann.nearest(spark, vectors.where("false"), vectors, 20).count() == 0


def test_shards_are_searched_together(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(600)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ann.build_index(spark, ann.usable(vectors, "vec_id", "embedding"), 5, shard_rows=100)
    assert index.select("shard").distinct().count() > 3
    found = ann.search(spark, index, ann.usable(vectors.where("vec_id < 50"), "vec_id", "embedding"), 5, block_rows=20).collect()
    v, hit = np.array([r[1] for r in rows]), 0
    for q in range(50):
        score = v @ v[q]
        score[q] = -np.inf
        hit += len(set(np.argsort(-score)[:5].tolist()) & {r["vec_id"] for r in found if r["query_id"] == q})
    assert hit / 250 >= 0.9


# --- 8 suffix tree ---

def test_base_scores_and_counts(spark, docs):
    rows = docs + ODD
    frame = odd(spark, rows).select("doc_id", "text", F.lit(False).alias("held_out"))
    training = [t or "" for i, t in rows if i is not None and i % 2]
    counts = Counter()
    for t in training:
        counts.update([*t.encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    got = suffix_tree.score_documents(spark, frame, frame.where("doc_id % 2 = 1"), head_share=1e-3).collect()
    want = Counter()
    for i, t in rows:
        words = [*(t or "").encode().lower().split(), b""]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        want[i, len(words), sum(counts[w] > 0 for w in words), n, round(base, 4)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    nothing = suffix_tree.score_documents(spark, frame, frame.where("false")).collect()
    assert len(nothing) == len(rows) and all(r["score"] == 0 for r in nothing)


def test_distributions_sum_to_one():
    # Words 1 and 2 follow each other, 3 and 4 are rare; the end is 0.
    level = suffix_tree.Level(np.array([0, 1, 2]), np.array([10, 50, 50]), np.full(3, -1))
    level.entries = np.array([0 << 32 | 1, 1 << 32 | 2, 2 << 32 | 1])
    level.entry_count = np.array([9, 45, 40])
    root = np.array([0.1, 0.35, 0.35, 0.1])
    tree = suffix_tree.build_tree([level], root)
    assert tree.kept[1:].any()
    for before in (0, 1, 2, 3):
        def score(w):
            flat = np.array([before, w])
            return 10 ** tree.score(flat, suffix_tree.states(tree.levels, flat, np.array([0])))[1]

        total, other = sum(map(score, range(4))), score(-1) * (1 - root.sum())
        assert total + other == pytest.approx(1)


def test_tree_learns_what_follows(spark):
    texts = [(i, "the quick brown fox jumps over the lazy dog") for i in range(50)] + [(100 + i, f"noise{i} other{i} words{i}") for i in range(50)]
    frame = spark.createDataFrame([(i, t, False) for i, t in texts], "doc_id long, text string, held_out boolean")
    got = {r["doc_id"]: r for r in suffix_tree.score_documents(spark, frame, frame, context_share=1e-3, entry_share=1e-3).collect()}
    assert got[0]["score"] > got[0]["base_score"] + 3


# --- 9 mixing ---

def test_flight_keeps_totals():
    from random import Random

    rng = np.random.default_rng(4)
    sizes, probs = rng.integers(0, 500, 400).astype(float).tolist(), rng.uniform(0, 1, 400).tolist()
    flown = mixing.flight(sizes, probs, Random(1))
    assert sum(0 < p < 1 for p in flown) <= 2 and sum(flown) == pytest.approx(sum(probs), abs=1e-5)
    assert np.dot(sizes, flown) == pytest.approx(np.dot(sizes, probs), abs=1e-2)


def test_targets_fill_like_water():
    goal = mixing.targets({"b": 100, "a": 10, None: 50}, (3.0, 1.0, 2.0), 1.5, 2.0)
    assert goal["a"] == 20 and sum(goal.values()) == pytest.approx(240)
    assert goal["b"] == pytest.approx(220 / 3) and goal[None] == 100 or goal["b"] == pytest.approx(120)


def test_mix_meets_targets(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, ("hot", "b", "c", None)[0 if i % 3 else i // 3 % 4], int(n)) for i, n in enumerate(rng.integers(0, 900, 4000))]
    frame = spark.createDataFrame([*rows, (None, "b", 3), (7, "hot", 5), (7, "hot", 5)], "key long, source string, size long")
    for block in (10_000, 100):
        got = mixing.mix(spark, frame, block_rows=block).collect()
        again = mixing.mix(spark, frame.repartition(5), block_rows=block).collect()
        assert multiset(got) == multiset(again) and len(got) == len(rows) + 3
        taken, goal = Counter(), {}
        for r in got:
            assert 0 <= r["copies"] <= 2
            taken[r["source"]] += r["size"] * r["copies"]
            goal[r["source"]] = r["target"]
        assert all(abs(taken[s] - goal[s]) <= 0.002 * goal[s] + 5 for s in goal)
    assert mixing.mix(spark, frame.where("false")).count() == 0


# --- queries and pipeline ---

def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(ORACLES) <= set(QUERIES)


def test_oracles(spark):
    import os
    import sys

    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
    import compare as tool

    con = tool.connect(SF)
    for name, sql in ORACLES.items():
        assert tool.compare(spark, con, name, QUERIES[name], sql, SF) == ""


def test_pipeline_equals_its_parts(spark):
    """Each stage against brute force on what the stage before kept."""
    from postmatch.llm.common import Stager

    stage, docs = Stager(spark), table(spark, SF, "documents")
    columns, kept = docs.columns, []
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, SF), f"test_{name}")
        assert docs.columns == columns
        kept.append([tuple(r) for r in docs.select("doc_id", "text", "source").collect()])
    predicted = {r["doc_id"] for r in QUERIES["op4_quality_classifier"](spark, SF).where("predicted = 1").collect()}
    assert {i for i, _, _ in kept[0]} == predicted
    judged = quality_rules.quality_rules(spark, table(spark, SF, "documents")).where("kept").select("doc_id").collect()
    assert {i for i, _, _ in kept[1]} == {r["doc_id"] for r in judged} & predicted
    # Texts linked at a Jaccard similarity of 0.8 or more of five-word shingles: one document of each group stays.
    shingles = {i: {tuple(w[a:a + 5]) for a in range(max(len(w) - 4, 1))} for i, w in ((i, (t or "").split()) for i, t, _ in kept[1])}
    root = {i: i for i in shingles}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(shingles), 2):
        if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
            root[find(b)] = find(a)
    groups = {find(i) for i in shingles}
    assert len(kept[2]) == len(groups) == len({find(i) for i, _, _ in kept[2]})
    copies = Counter(i for i, _, _ in kept[3])
    assert max(copies.values()) <= 2 and set(copies) <= {i for i, _, _ in kept[2]}
    packed = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == copies


def test_labels_of_held_out_rows_are_not_read(spark):
    labels = table(spark, SF, "labels")
    known = training_labels(labels, "quality", 5, 0)
    assert not [r for r in known.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert training_labels(labels.where("false"), "toxic", 4, 2).count() == 0
