"""Language identification by hyperdimensional profiles.

Every letter, and the blank between words, has a random vector of -1 and 1. A run of three is the product of its letters' vectors, rotated by
their place (binding); a text is the sum of its runs (bundling), and so is a language over its texts. The language whose profile has the
greatest cosine with a text is predicted. Sums are of integers, so neither batches nor the order of rows change a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stager, byte_slices, folded, share, shared, table

#: Components of a vector, letters of a run, seed of the letters' vectors.
DIMENSION, RUN, SEED = 1_024, 3, 20_260
#: Bounds of what is learnt: texts of a language (on average), languages (the most frequent).
TEXTS_PER_LANGUAGE, LANGUAGES = 4_000, 1_000
#: Texts and runs that are bundled at a time (one long text may exceed the latter), and run vectors held at a time.
TEXTS_AT_ONCE, RUNS_AT_ONCE, VECTORS_AT_ONCE = 64, 200_000, 8_192
UNKNOWN = "und"
_UNIT = 1 << 20


def letter_vector(code: int, dimension: int) -> np.ndarray:
    return (np.random.default_rng([SEED, code]).integers(0, 2, dimension) * 2 - 1).astype("float32")


@dataclass
class Alphabet:
    """Code points as symbols (0 is the blank, letters are themselves) and the vectors of symbols, both made as they are met."""

    dimension: int = DIMENSION
    _symbol: np.ndarray = field(default_factory=lambda: np.full(0x110000, -1, "int32"))
    _vectors: dict[int, np.ndarray] = field(default_factory=dict)

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        found = self._symbol[codes]
        if (found < 0).any():
            new = np.unique(codes[found < 0])
            self._symbol[new] = [c if chr(c).isalpha() else 0 for c in new.tolist()]
            found = self._symbol[codes]
        return found

    def vectors(self, symbols: np.ndarray) -> np.ndarray:
        for c in symbols.tolist():
            if c not in self._vectors:
                self._vectors[c] = letter_vector(c, self.dimension)
        return np.stack([self._vectors[c] for c in symbols.tolist()])

    def bundles(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """(texts, dimension) of whole texts, a few at a time, in their order; rows of zeros for texts without a letter."""
        start = letters = 0
        lowered = [f" {t.lower()} " if t else "" for t in texts]
        for i, t in enumerate(lowered):
            if i > start and (i - start >= TEXTS_AT_ONCE or letters + len(t) > RUNS_AT_ONCE):
                yield self._bundle(lowered[start:i])
                start, letters = i, 0
            letters += len(t)
        if start < len(lowered):
            yield self._bundle(lowered[start:])

    def _bundle(self, lowered: list[str]) -> np.ndarray:
        codes = np.frombuffer("".join(lowered).encode("utf-32-le"), "<u4")
        text = np.repeat(np.arange(len(lowered)), [len(t) for t in lowered])
        symbol = self.symbols(codes)
        doubled = np.zeros(len(symbol), bool)
        doubled[1:] = (symbol[1:] == 0) & (symbol[:-1] == 0) & (text[1:] == text[:-1])
        symbol, text = symbol[~doubled], text[~doubled]
        whole = text[:-2] == text[2:] if len(text) > 2 else np.zeros(0, bool)
        out = np.zeros((len(lowered), self.dimension))
        if not whole.any():
            return out
        used, place = np.unique(symbol, return_inverse=True)
        letters, k = self.vectors(used), len(used)
        code = (place[:-2][whole] * k + place[1:-1][whole]) * k + place[2:][whole]
        runs, which = np.unique(code, return_inverse=True)
        cell, count = np.unique(text[:-2][whole] * len(runs) + which, return_counts=True)
        counts = np.zeros((len(lowered), len(runs)), "float32" if len(code) < 1 << 24 else "float64")  # whole numbers stay exact
        counts.ravel()[cell] = count
        first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
        for a in range(0, len(runs), VECTORS_AT_ONCE):
            r = runs[a:a + VECTORS_AT_ONCE]
            out += counts[:, a:a + VECTORS_AT_ONCE] @ (first[r // (k * k)] * second[r // k % k] * letters[r % k])
        return out


@dataclass
class Profiles:
    """Languages by name and their unit profile vectors."""

    languages: list[str]
    vectors: np.ndarray

    def nearest(self, bundles: np.ndarray) -> tuple[list[str], np.ndarray]:
        """(language, cosine held to 0..1) of every text; the first by name on a tie, und and 0 without letters or languages."""
        length = np.linalg.norm(bundles, axis=1)
        if not self.languages:
            return [UNKNOWN] * len(bundles), np.zeros(len(bundles))
        cosines = (bundles @ self.vectors.T) / np.maximum(length, 1e-300)[:, None]
        best = cosines.argmax(axis=1)
        score = np.where(length > 0, np.clip(cosines[np.arange(len(best)), best], 0.0, 1.0), 0.0)
        return [self.languages[b] if n > 0 else UNKNOWN for b, n in zip(best.tolist(), length.tolist(), strict=True)], score


def learn(
    spark: SparkSession, examples: DataFrame, dimension: int = DIMENSION, texts_per_language: int = TEXTS_PER_LANGUAGE, languages: int = LANGUAGES,
) -> Profiles:
    """Profiles from ``examples`` (text, lang): about ``texts_per_language`` texts of each of the ``languages`` most frequent values, chosen by
    a hash of the text. Every text counts alike, however long. Rows with a null or no letter teach nothing.
    """
    examples = examples.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    share_of = Stager(spark)(
        examples.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
        .select("lang", (F.least(F.lit(1.0), texts_per_language / F.col("n")) * (1 << 30)).cast("long").alias("share")), "languages")
    # At most ``languages`` rows.
    part = examples.join(F.broadcast(share_of), "lang").where(F.pmod(F.xxhash64(F.lit("profile"), "text"), F.lit(1 << 30)) < F.col("share")).select("lang", "text")

    def bundle(batches):
        alphabet, sums = Alphabet(dimension), {}
        for whole in batches:
            for b in byte_slices(iter([whole]), "text"):
                at, names = 0, b.column("lang").to_pylist()
                for bundles in alphabet.bundles(b.column("text").to_pylist()):
                    length = np.linalg.norm(bundles, axis=1)
                    for unit, name in zip(bundles / np.maximum(length, 1e-300)[:, None], names[at:at + len(bundles)], strict=True):
                        sums[name] = sums.get(name, 0) + np.rint(unit * _UNIT).astype("int64")
                    at += len(bundles)
        if sums:
            yield pa.record_batch({"lang": list(sums), "sums": pa.array([s.tolist() for s in sums.values()], pa.list_(pa.int64()))})

    def meet(t: pa.Table) -> pa.Table:
        total = t["sums"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1).sum(axis=0)
        return pa.table({"lang": t["lang"].slice(0, 1), "sums": pa.array([total.tolist()], pa.list_(pa.int64()))})

    # One row per task and language, at most as many as texts in the sample.
    found = part.mapInArrow(bundle, "lang string, sums array<long>").groupBy("lang").applyInArrow(meet, "lang string, sums array<long>")
    rows = sorted(((r["lang"], r["sums"]) for r in found.collect() if any(r["sums"])), key=lambda r: r[0])
    vectors = np.array([s for _, s in rows], float).reshape(-1, dimension)
    return Profiles([name for name, _ in rows], vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300))


def identify(spark: SparkSession, docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (these replace columns of their names) for every row and whole text, in one pass without a shuffle.

    A text that is null or has no letter gets ``und`` and 0, as does every text where nothing was learnt. Rows that repeat are rows of their own.
    """
    sent, kept = share(spark, profiles), [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*[docs[c] for c in kept], *([] if text in kept else [docs[text]]))
    dimension = profiles.vectors.shape[1]

    def run(batches):
        model, alphabet = shared(sent), Alphabet(dimension)
        for whole in batches:
            for b in byte_slices(iter([whole]), text):
                names, scores = [], [np.zeros(0)]
                for bundles in alphabet.bundles(b.column(text).to_pylist()):
                    found, score = model.nearest(bundles)
                    names += found
                    scores.append(score)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in kept), pa.array(names, pa.string()), pa.array(np.concatenate(scores))], names=[*kept, "lang_pred", "score"])

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "lang_pred string", "score double"])
    return rows.mapInArrow(run, schema)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = folded("doc_id", 5)
    profiles = learn(spark, docs.where(F.col("doc_id").isNotNull() & (fold != 0)).select("text", "lang"))
    return identify(spark, docs.select("doc_id", (fold == 0).alias("held_out"), "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")
