"""Which keywords a text contains, by Aho-Corasick automata.

Keywords are dealt over automata of bounded size. Each text passes each automaton once, and only hits leave the task: rows and shuffle grow
with hits, not with characters or with texts times keywords.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the keywords of one automaton, which has at most one node more; this is also what is sent to the tasks at a time.
AUTOMATON_CHARS = 2_000_000


def _automaton(words: list[str]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for number, word in enumerate(words):
        if word:
            automaton.add_word(word, number)
    automaton.make_automaton()
    return automaton


def _hits(texts: DataFrame, text: str, item: str, words: list[str]) -> DataFrame:
    """Rows (``item``, keyword) for the words of one automaton; the empty word is part of every text."""
    empty = [n for n, w in enumerate(words) if not w]
    only_empty = len(empty) == len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, spelled = _automaton(words), pa.array(words, pa.string())
        for batch in batches:
            row, found = [], []
            for at, body in enumerate(batch.column(text).to_pylist()):
                if body is None:
                    continue
                inside = set() if only_empty else {n for _, n in automaton.iter(body)}
                inside.update(empty)
                row += [at] * len(inside)
                found += inside
            yield pa.RecordBatch.from_arrays(
                [batch.column(item).take(pa.array(np.array(row, "int64"))), spelled.take(pa.array(np.array(found, "int64")))], [item, "keyword"])

    kind = dict(texts.dtypes)[item]
    return texts.select(item, text).mapInArrow(run, f"`{item}` {kind}, keyword string")


def keyword_hits(texts: DataFrame, text: str, item: str, keywords: DataFrame, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """Rows (``item``, keyword) for every distinct keyword contained in ``text``, each pair once for every row of ``texts``.

    Containment is of code points, case and blanks included. A null text contains nothing, the empty keyword is part of every other text, null
    keywords count for nothing. One small job sizes the keywords; they are dealt over as many automata as ``automaton_chars`` asks for, by a
    hash, and come to the driver one automaton at a time.
    """
    distinct = keywords.select("keyword").where(F.col("keyword").isNotNull()).distinct()
    chars = distinct.agg(F.sum(F.greatest(F.length("keyword"), F.lit(1)))).first()[0] or 0
    automata = -(-chars // automaton_chars)
    out = None
    for number in range(automata):
        part = distinct if automata == 1 else distinct.where(F.pmod(F.xxhash64("keyword"), F.lit(automata)) == number)
        hits = _hits(texts, text, item, sorted(r["keyword"] for r in part.collect()))
        out = hits if out is None else out.unionByName(hits)
    return texts.select(item, F.lit("").alias("keyword")).where(F.lit(False)) if out is None else out
