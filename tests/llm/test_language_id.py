"""Language identification against a plain computation of the same profiles, and by held-out accuracy."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmatch.llm import language_id as li
from postmatch.llm.common import table
from postmatch.llm.queries import QUERIES

KIND = "doc_id long, text string, lang string, score string, lang_pred int, symbol int"
TEXTS = [
    (1, None), (2, ""), (3, " \n\t 12 -- "), (4, "Word"), (5, "a"), (5, "a"), (None, "der die das und"), (6, "ÉCOLE été\x00naïf  x"),
    (7, "한글 И ещё 😀 straße İstanbul"), (8, "the of and " * 9_000), (9, "the of and " * 2), (10, "..the..of..and.."),
]


def plain_bundle(text, dimension):
    """Sum of the products of rotated letter vectors over all runs of three, letter by letter."""
    symbols = [0]
    for c in (text or "").lower():
        s = ord(c) if c.isalpha() else 0
        if s or symbols[-1]:
            symbols.append(s)
    if symbols[-1]:
        symbols.append(0)
    total = np.zeros(dimension)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False):
        total += np.roll(li.letter_vector(a, dimension), 2) * np.roll(li.letter_vector(b, dimension), 1) * li.letter_vector(c, dimension)
    return total


def made(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 2) for i, t in rows], KIND)


@pytest.mark.parametrize("at_once", [1, 3, 64])
def test_bundles_equal_the_plain_sum(at_once, monkeypatch):
    monkeypatch.setattr(li, "TEXTS_AT_ONCE", at_once)
    monkeypatch.setattr(li, "VECTORS_AT_ONCE", 5)
    texts = [t for _, t in TEXTS]
    found = np.concatenate(list(li.Alphabet(256).bundles(texts)))
    assert (found == np.array([plain_bundle(t, 256) for t in texts])).all()


def test_learnt_profiles_and_predictions_equal_the_plain_ones(spark):
    rows = [("en", "the cat of the house"), ("en", "and the other one"), ("de", "der Hund und die Katze"), ("fr", "le chat de la maison"), ("de", None), (None, "el gato"),
            ("xx", "123")]
    examples = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    profiles = li.learn(spark, examples, dimension=512)
    assert profiles.languages == ["de", "en", "fr"]
    sums = {}
    for name, text in rows:
        if name in profiles.languages and text:
            v = plain_bundle(text, 512)
            sums[name] = sums.get(name, 0) + np.rint(v / np.linalg.norm(v) * (1 << 20))
    want = np.array([sums[name] / np.linalg.norm(sums[name]) for name in profiles.languages])
    assert np.allclose(profiles.vectors, want)
    found = li.identify(spark, made(spark, TEXTS).repartition(3), profiles)
    assert found.columns == ["doc_id", "text", "lang", "symbol", "lang_pred", "score"]
    by = {}
    for r in found.collect():
        by.setdefault((r["doc_id"], r["text"]), []).append((r["lang_pred"], r["score"]))
    assert len(by[(5, "a")]) == 2 and sum(map(len, by.values())) == len(TEXTS)
    for i, t in TEXTS:
        v = plain_bundle(t, 512)
        for name, score in by[(i, t)]:
            if not v.any():
                assert (name, score) == ("und", 0.0)
            else:
                cosines = want @ v / np.linalg.norm(v)
                assert name == profiles.languages[int(cosines.argmax())] and abs(score - max(cosines.max(), 0)) < 1e-9


def test_nothing_learnt_and_no_rows(spark):
    empty = li.learn(spark, spark.createDataFrame([], "text string, lang string"))
    assert empty.languages == []
    assert {(r["lang_pred"], r["score"]) for r in li.identify(spark, made(spark, TEXTS), empty).collect()} == {("und", 0.0)}
    assert li.identify(spark, made(spark, []), empty).count() == 0


def test_only_the_most_frequent_languages_are_learnt(spark):
    rows = [("b", "one"), ("a", "two"), ("c", "three"), ("c", "four")]
    assert li.learn(spark, spark.createDataFrame(rows, "lang string, text string"), languages=2).languages == ["a", "c"]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in table(spark, sf, "documents").collect()}
    found = QUERIES["op13_language_id"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in found)
    held = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in found if r["held_out"]]
    assert len(held) > 150 and sum(held) >= 0.98 * len(held)
    assert {r["lang_pred"] for r in found} <= {d["lang"] for d in docs.values()} | {"und"}
    again = QUERIES["op13_language_id"](spark, sf)
    assert again.where(F.col("held_out").isNull() | F.col("lang_pred").isNull()).count() == 0
