"""Whole texts as token ids of a public tokenizer, fast where many words repeat.

A text is cut before single spaces, where byte-level pre-tokenisation always cuts; the pieces' ids
come from the tokenizers library and are kept per worker. Texts for which such cuts could matter
(runs of white space around a space, special strings, control separators) are encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

from fieldframe.llm.batches import trim

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

UNSAFE = re.compile(r"\s (?:\s|\Z)|[\x1c-\x1f\x85]")
#: Single newlines between characters that are not white space, or one at the end.
LINES = re.compile(r"\S+(?:\n\S+)*\n?")
PUNCTUATION = ".,;:!?$%&#*|)"
#: An ASCII text that UNSAFE matches holds one of these.
SUSPECT = ("  ", "\n ", "\t ", "\r", "\v", "\f", "\x1c", "\x1d", "\x1e", "\x1f")
KEPT = 1_000_000
_encoders: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def unsafe(text: str) -> bool:
    """Whether cutting at single spaces could change ids; plain texts are told apart without the pattern."""
    if text.isascii() and not any(c in text for c in SUSPECT):
        return False
    return UNSAFE.search(text) is not None


def single(word: str) -> bool:
    """Whether a word is surely one pre-token: Latin letters, or ASCII digits."""
    return word.isalpha() and max(word) < "ɐ" or word.isascii() and word.isdigit()


class Encoder(dict):
    """Ids of the piece " " + word by word, as bytes of 32-bit unsigned little-endian integers."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = {b: c for b, c in _byte_letters().items() if chr(b) != c}
        self.space, self.tokenize = self.letters[32], self.model.tokenize
        self.coded = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.heads: dict[str, bytes] = {}
        self.newline = self.whole("\n")
        step = self.tokenizer.pre_tokenizer
        self.byte_level = type(step).__name__ == "ByteLevel" and self.tokenizer.normalizer is None

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        """Ids of a piece that is not kept yet, from parts that pre-tokenisation cuts anyway."""
        plain = word.rstrip(PUNCTUATION)
        if plain != word and plain and plain[-1].isalnum():
            ids = self[plain] + self.head(word[len(plain):])
        elif "\n" in word and LINES.fullmatch(word):
            # a newline between other characters is a piece of its own; such pieces seldom repeat and are not kept
            first, *others = word.split("\n")
            return self[first] + b"".join([self.newline + self.head(line) for line in others])
        elif single(word):
            ids = self.model_ids(word, self.space)
        else:
            ids = self.whole(" " + word)
        self[word] = ids
        return ids

    def model_ids(self, word: str, before: str = "") -> bytes:
        """Ids of one pre-token of letters or digits, which stand for themselves where they are ASCII."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        coded = self.coded
        return b"".join([coded[t.id] for t in self.tokenize(before + word)])

    def head(self, word: str) -> bytes:
        """Ids of a word without a space before it; kept apart."""
        ids = self.heads.get(word)
        if ids is None:
            if len(self.heads) > KEPT // 4:
                self.heads.clear()
            plain = word.rstrip(PUNCTUATION)
            if plain != word and plain and plain[-1].isalnum():
                ids = self.head(plain) + self.head(word[len(plain):])
            elif single(word):
                ids = self.model_ids(word)
            else:
                ids = self.whole(word) if word else b""
            self.heads[word] = ids
        return ids

    def raw(self, text: str | None) -> bytes:
        """Ids of a text as bytes; of a null or empty text none."""
        if not text:
            return b""
        if not self.byte_level or unsafe(text) or any(s in text for s in self.special):
            return self.whole(text)
        if len(self) > KEPT:
            self.clear()
        head, *words = text.split(" ")
        return self.head(head) + b"".join(map(self.__getitem__, words))

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of a text; of a null or empty text none."""
        return np.frombuffer(self.raw(text), "<u4")


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file, made once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Let go of the worker's encoders and what they keep; the next use makes them anew."""
    _encoders.clear()
    trim()
