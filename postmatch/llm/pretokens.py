"""Pre-tokens and ids of blank-free chunks, as a tokenizer file gives them, each distinct one worked out once per task.

For tokenizers that drop blanks, so that a text may be cut at spaces and line feeds first. Special strings are found in the raw text
before anything else, as the library does.
"""

from __future__ import annotations

import json
import re
from collections import Counter

#: The configuration for which :data:`PLAIN` chunks are split by :data:`SPLIT` here instead of by the library.
KNOWN_NORMALIZER = [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)]
KNOWN_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Printable ASCII and the Latin letters up to U+024F, without the one whose lower case is two characters: composed, and alike in Python.
PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ɏ]+")
PLAIN_TEXT = re.compile("[ \n!-~À-ÖØ-öø-įı-ɏ]*")
#: The known split over lower-cased plain text: Latin letters (some lower cases lie beyond U+024F), then the rest in the same order.
SPLIT = re.compile("[a-zß-öø-ʯⱠ-Ɀ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[!-/:-@[-`{-~]+")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(other)}


class PreTokens(dict):
    """Chunk -> tuple of pre-tokens in the tokenizer's own alphabet; a special string is a pre-token of its own."""

    def __init__(self, path: str, limit: int = 600_000):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=lambda s: (-len(s), s)))) + ")") if added else None
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        steps = (config["normalizer"] or {}).get("normalizers", [])
        splits = (config["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.known = (
            [(s["type"], s.get("pattern", {}).get("Regex")) for s in steps] == KNOWN_NORMALIZER
            and [s.get("type") for s in splits] == ["Split", "ByteLevel"] and splits[0]["pattern"].get("Regex") == KNOWN_SPLIT
            and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"]
        )
        self.letters = byte_letters()

    def spelt(self, plain: str) -> str:
        """A pre-token in the tokenizer's alphabet, in which printable ASCII stands for itself."""
        return plain if plain.isascii() else plain.encode().decode("latin-1").translate(self.letters)

    def plain(self, text: str) -> list[str] | None:
        """Pre-tokens of a whole text in its own letters, or None where only the library can tell them."""
        if self.known and PLAIN_TEXT.fullmatch(text) and not any(s in text for s in self.special):
            return SPLIT.findall(text.lower())
        return None

    def counted(self, text: str) -> dict[str, int]:
        """Frequencies of the pre-tokens of a whole text."""
        found = self.plain(text)
        if found is not None:
            counts = Counter(found)
            return counts if text.isascii() else {self.spelt(p): n for p, n in counts.items()}
        counts = Counter()
        for chunk, n in Counter(chunks_of(text)).items():
            for p in self[chunk]:
                counts[p] += n
        return counts

    def split(self, part: str) -> list[str]:
        """Pre-tokens of a chunk without special strings."""
        if self.known and PLAIN.fullmatch(part):
            found = SPLIT.findall(part.lower())
            return found if part.isascii() else list(map(self.spelt, found))
        norm = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(norm)]

    def __missing__(self, chunk: str) -> tuple[str, ...]:
        if self.cut and "<" in chunk or not self.known:
            found: list[str] = []
            for part in self.cut.split(chunk) if self.cut else [chunk]:
                found.extend([part] if part in self.special else self.split(part) if part else [])
        else:
            found = self.split(chunk) if chunk else []
        return self.keep(chunk, tuple(found))

    def keep(self, chunk: str, made):
        if len(chunk) <= 100:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = made
        return made

    def pieces(self, pre_token: str) -> int:
        return 1 if pre_token in self.special else len(self.tokenizer.model.tokenize(pre_token))


class PlainIds(dict):
    """Pre-token in its own letters -> ids of its spelling in the tokenizer's alphabet. Its owner bounds it."""

    def __init__(self, owner: ChunkIds):
        super().__init__()
        self.tokenize, self.code, self.spelt = owner.tokenizer.model.tokenize, owner.code, owner.spelt

    def __missing__(self, pre_token: str) -> bytes:
        code = self.code
        made = self[pre_token] = b"".join([code[t.id] for t in self.tokenize(self.spelt(pre_token))])
        return made


class ChunkIds(PreTokens):
    """Chunk -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, limit: int = 600_000):
        super().__init__(path, limit)
        self.code = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.plain_ids = PlainIds(self)

    def encoded(self, pre_token: str) -> bytes:
        if pre_token in self.special:
            return self.code[self.special[pre_token]]
        return b"".join([self.code[t.id] for t in self.tokenizer.model.tokenize(pre_token)])

    def keep(self, chunk: str, made: tuple[str, ...]) -> bytes:
        return super().keep(chunk, b"".join(map(self.encoded, made)))

    def text(self, text: str) -> bytes:
        found = self.plain(text)
        if found is not None:
            if len(self.plain_ids) > self.limit:
                self.plain_ids.clear()
            return b"".join(map(self.plain_ids.__getitem__, found))
        return b"".join(map(self.__getitem__, chunks_of(text)))


def chunks_of(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")
