"""The rare contexts of a suffix tree: all of them, by absolute counts, two and three words long.

A context of two words that is too rare for the shared head of the tree is looked at in a bucket of its own, chosen by its two words; where
these are in the head and only the three words are too rare for it, the bucket is chosen by the three. Every token behind such a context
goes there with the three words in front of it, from training texts and from texts to score alike, so one shuffle both counts the
contexts and answers the texts. Nothing but a bucket is held in memory: about ``bucket_rows`` tokens, and at most the head's share of
contexts more, since a context above that share is not sent.

A context is a candidate if training texts hold it :data:`LEAST` times or more, a symbol is listed if it follows as often, and the context
stays if its distribution diverges from that of the suffix by more than chance. So what is gathered grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

LEAST = 2
DISCOUNT = 0.75
#: Ids of words outside the head carry this bit and a hash; BEYOND stands for what lies before the start of a text.
RARE, BEYOND = 1 << 30, (1 << 31) - 1
DEEPEST = 3
#: Pieces that a bucket is worked through in, which bounds what is held beside it.
PIECES = 8


def word_ids(words: list[list[bytes]], flat: np.ndarray) -> np.ndarray:
    """Ids of all tokens: those of the head as they are, others by hash."""
    full = flat.copy()
    outside = np.flatnonzero(flat < 0)
    if len(outside):
        every = list(chain.from_iterable(words))
        full[outside] = [RARE | xxhash.xxh32_intdigest(every[i]) & (RARE - 2) for i in outside.tolist()]
    return full


def before(full: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of every token in its text, and the ids of the 1st, 2nd, ... word in front of it (0: the start)."""
    lengths = np.diff(np.append(starts, len(full)))
    place = np.arange(len(full)) - np.repeat(starts, lengths)
    out = np.full((DEEPEST, len(full)), BEYOND, "int32")
    for k in range(1, DEEPEST + 1):
        out[k - 1][place == k - 1] = 0
        at = np.flatnonzero(place >= k)
        out[k - 1][at] = full[at - k]
    return place, out


def marked(rows: np.ndarray, learn: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Row ids with two marks: learn from the text, give back its gain."""
    return rows << 2 | score.astype("int64") << 1 | learn


def _planes(numbers: np.ndarray) -> bytes:
    """Rows of numbers as bytes; bytes of one rank lie together, which is what compresses them."""
    wide = np.ascontiguousarray(numbers)
    return np.ascontiguousarray(wide.view("uint8").reshape(*wide.shape, wide.itemsize).transpose(0, 2, 1)).tobytes()


def _restored(raw: bytes, rows: int, kind: str = "int32") -> np.ndarray:
    planes = np.frombuffer(raw, "uint8").reshape(rows, np.dtype(kind).itemsize, -1).transpose(0, 2, 1)
    return np.ascontiguousarray(planes).view(kind).reshape(rows, -1)


def texts_as_bytes(full: np.ndarray, starts: np.ndarray) -> list[bytes]:
    squeeze = zstandard.ZstdCompressor(level=1)
    return [squeeze.compress(_planes(full[None, a:b].astype("int32"))) for a, b in zip(starts, np.append(starts[1:], len(full)), strict=True)]


def texts_from_bytes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all tokens, where each text starts)."""
    widen = zstandard.ZstdDecompressor()
    texts = [_restored(widen.decompress(b), 1)[0] for b in blobs]
    return np.concatenate(texts).astype("int64"), np.cumsum([0, *map(len, texts[:-1])])


def packed(context: np.ndarray, symbol: np.ndarray, rows: np.ndarray, buckets: int, by_three: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
    """(bucket, tokens) by the two words of the context, or by three where ``by_three`` says so; ``rows`` holds for every token what :func:`answers` gives back."""
    mixed = context[0].astype("uint64") * np.uint64(0x9E3779B97F4A7C15) ^ context[1].astype("uint64") * np.uint64(0xC2B2AE3D27D4EB4F)
    if by_three is not None:
        mixed ^= np.where(by_three, context[2].astype("uint64") * np.uint64(0x165667B19E3779F9), np.uint64(0))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype("int32")
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    # Which word outside the head follows makes no difference.
    words, steps = np.concatenate([context, np.minimum(symbol, RARE)[None].astype("int32")])[:, order], rows[order]
    squeeze = zstandard.ZstdCompressor(level=1)
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        part = slice(cuts[b], cuts[b + 1])
        yield b, squeeze.compress(_planes(words[:, part]) + _planes(np.diff(steps[part], prepend=0)[None]))


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(words, rows) of a part of a bucket: the words in front, nearest first, then the symbol."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    cut = len(raw) // (4 * (DEEPEST + 1) + 8) * 4 * (DEEPEST + 1)
    return _restored(raw[:cut], DEEPEST + 1), np.cumsum(_restored(raw[cut:], 1, "int64")[0])


def gains(words: np.ndarray, learn: np.ndarray, p: np.ndarray, shallowest: int = 2) -> np.ndarray:
    """For every token of a bucket, log10 of what the contexts of ``shallowest`` words and more multiply its probability ``p`` with.

    ``learn`` marks the tokens of training texts. Only words of the head are listed; others take the weight that is left. A token's
    context is the longest kept one; each kept context gives (count - discount) / n and hands the rest to the next shorter.
    """
    symbol, now = words[DEEPEST].astype("int64"), p.copy()
    alive = np.arange(len(symbol))
    group = words[0].astype("int64") << 32 | words[1]
    for depth in range(2, DEEPEST + 1):
        if depth > 2:
            ahead = words[depth - 1][alive]
            on = ahead != BEYOND
            alive, group = alive[on], group[on] << 32 | ahead[on]
        if not len(alive):
            break
        _, group = np.unique(group, return_inverse=True)
        if depth < shallowest:
            continue
        n = np.bincount(group, weights=learn[alive])
        often = n[group] >= LEAST
        alive, group = alive[often], group[often]
        if not len(alive):
            break
        entries, first, entry = np.unique(group << 32 | symbol[alive], return_index=True, return_inverse=True)
        c = np.bincount(entry, weights=learn[alive])
        owner, q = entries >> 32, now[alive][first]
        listed = (c >= LEAST) & (entries & 0xFFFFFFFF < RARE)
        at, size = owner[listed], len(n)
        total = lambda w: np.bincount(at, weights=w, minlength=size)
        cl, ql, nl = c[listed], q[listed], n[at]
        other_p, other_q = np.clip(1 - total(cl / nl), 1e-12, 1), np.clip(1 - total(ql), 1e-12, 1)
        gain = n * (total(cl / nl * np.log(cl / nl / ql)) + other_p * np.log(other_p / other_q))
        free = np.bincount(at, minlength=size)
        kept = (free > 0) & (2 * gain > free + 4 * np.sqrt(2 * free))
        rest = np.maximum(1 - total((cl - DISCOUNT) / nl), 1e-9)
        seen = np.where(listed, np.maximum(c - DISCOUNT, 0) / np.maximum(n[owner], 1), 0.0)
        inside = kept[group]
        hit = alive[inside]
        now[hit] = seen[entry[inside]] + rest[group[inside]] * now[hit]
    return np.log10(now) - np.log10(p)


def answers(blobs: list[bytes], head: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, sum of gains) of the texts that a bucket changes; rows as :func:`marked` makes them.

    ``head(words in front, symbol)`` is the probability that the head of the tree gives (1 for words outside the head), and whether the two
    words in front are a context of the head, so that only the three are looked at here.
    """
    parts = [unpacked(b) for b in blobs]
    words, rows = np.concatenate([w for w, _ in parts], axis=1), np.concatenate([r for _, r in parts])
    del parts
    gain = np.zeros(len(rows))
    # A piece at a time, each with all that its contexts of two words hold.
    piece = (words[0] * np.int32(31) + words[1]) % PIECES
    for k in range(PIECES):
        at = np.flatnonzero(piece == k)
        if not len(at):
            continue
        own, learn = words[:, at], (rows[at] & 1).astype(float)
        p, known = head(own[:2].astype("int64"), own[DEEPEST].astype("int64"))
        for shallowest, of in ((2, np.flatnonzero(~known)), (3, np.flatnonzero(known))):
            if len(of):
                gain[at[of]] = gains(own[:, of], learn[of], p[of], shallowest)
    changed = (gain != 0) & (rows & 2 > 0)
    texts, where = np.unique(rows[changed] >> 2, return_inverse=True)
    return texts, np.bincount(where, weights=gain[changed], minlength=len(texts))


def sums_by_block(rows: np.ndarray, sums: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(block of 4,096 row ids, rows in order and their sums as bytes)."""
    squeeze = zstandard.ZstdCompressor(level=1)
    blocks, first = np.unique(rows >> 12, return_index=True)
    for block, a, b in zip(blocks.tolist(), first, [*first[1:], len(rows)], strict=True):
        yield block, squeeze.compress(_planes(np.diff(rows[a:b], prepend=0)[None]) + sums[a:b].tobytes())


def sums_from_bytes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    return np.cumsum(_restored(raw[:len(raw) // 2], 1, "int64")[0]), np.frombuffer(raw[len(raw) // 2:], "float64")
