"""Byte-pair encoding and decoding by a tokenization automaton compiled from the merges.

The automaton reads tokens. It starts as one state with an arc for every byte back to itself; then
one gadget per merge (u, v), in the order of the merges:

* the state that u leads to is copied without its arc v, and u leads to the copy from now on, so
  that v can no longer follow u;
* every state with an arc u gets an arc for the new token uv, which leads where v led.

A merge whose u leads to a state without the arc v is dead and adds nothing. In the end every byte
string has exactly one accepted token sequence, the one that merging in order gives.

A state differs from the one it was copied from by one missing arc, and new arcs follow from arcs
that were there, so all states share their arcs: ``cuts`` lists (token, token) pairs with the step
that cut them, and ``Automaton.arc`` answers from it whether the state a token leads to has an arc.
Answers met before are a table of transitions, one set of targets for each token.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fieldframe.llm.tokens import LINES, PUNCTUATION, single, unsafe

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pre-tokens of byte-level vocabularies: a fixed value.
PATTERN = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A place where pre-tokens always end: before a single space between characters that are not white space.
BREAK = regex.compile(r"(?<=\S) (?=\S)")
#: Characters of a text that are split at a time, pieces kept per worker, and the longest piece that is kept.
SLICE, KEPT, KEPT_CHARS = 1 << 20, 400_000, 64
START, FOREVER = -1, 1 << 60
_made: dict[str, Words] = {}


def byte_letters() -> dict[str, int]:
    """Bytes by the characters that stand for them: printable ones themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Automaton:
    """The compiled merges of a byte-level vocabulary: ``labels`` maps ids to byte strings."""

    def __init__(self, ids: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.labels = {i: b for b, i in ids.items()}
        self.width = max(self.labels, default=0) + 1
        self.made: dict[int, int] = {}  # step at which a token's arcs were added; 0 for bytes
        self.left: dict[int, int] = {}
        #: Tokens whose state a token's state descends from, each with the step from which on the descendants differ.
        self.lineage: dict[int, tuple[tuple[int, int], ...]] = {}
        self.cuts: dict[int, int] = {}
        for b, i in ids.items():
            if len(b) == 1:
                self.made[i] = 0
                self.lineage[i] = ((i, FOREVER),)
        for step, (u, v) in enumerate(merges, 1):
            self._gadget(step, ids[u], ids[v], ids[u + v])
        #: All beginnings of labels, which bound the search for arcs from one place of a word.
        self.begins: set[bytes] = set()
        self.tokens: dict[bytes, int] = {}
        for i in self.made:
            label = self.labels[i]
            self.tokens[label] = i
            self.begins.update(label[:k] for k in range(1, len(label) + 1))
        self.known: dict[int, bool] = {}

    def _gadget(self, step: int, u: int, v: int, new: int) -> None:
        if u not in self.made or v not in self.made or new in self.made or not self.arc(u, v):
            return
        # the new token leads where v led before this step: later cuts of v are not its own
        self.lineage[new] = ((new, FOREVER), *((t, min(until, step)) for t, until in self.lineage[v]))
        self.made[new], self.left[new] = step, u
        self.cuts[u * self.width + v] = step

    def arc(self, last: int, token: int) -> bool:
        """Whether the state that ``last`` leads to has an arc for ``token``."""
        cuts, width, made, left = self.cuts, self.width, self.made, self.left
        for ancestor, until in self.lineage[last]:
            base, t, limit = ancestor * width, token, FOREVER
            while True:
                step = cuts.get(base + t)
                # a cut counts while the state was the ancestor's, and before the arcs that grew from the cut one
                if step is not None and step < until and step <= limit:
                    return False
                if not made[t]:
                    break
                limit, t = made[t], left[t]
        return True

    def begun(self, word: bytes, at: int) -> list[int]:
        """Tokens whose labels start at a place of the word, longest last."""
        begins, tokens, out, n = self.begins, self.tokens, [], len(word)
        end = at + 1
        while end <= n and (piece := word[at:end]) in begins:
            token = tokens.get(piece)
            if token is not None:
                out.append(token)
            end += 1
        return out

    def encode(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the only accepted path over its bytes, long arcs tried first.

        A prefix of the word has one accepted path at most, so a place from which the end was not
        reached is never entered again, and the walk is linear in the word.
        """
        labels, known, width, n = self.labels, self.known, self.width, len(word)
        path, dead, state, at = [], set(), START, 0
        ahead = self.begun(word, 0)
        while at < n:
            while ahead:
                token = ahead.pop()
                end = at + len(labels[token])
                if end in dead:
                    continue
                if state != START:
                    key = state * width + token
                    holds = known.get(key)
                    if holds is None:
                        holds = known[key] = self.arc(state, token)
                    if not holds:
                        continue
                path.append((at, state, ahead, token))
                at, state = end, token
                ahead = self.begun(word, at)
                break
            else:
                dead.add(at)
                at, state, ahead, _ = path.pop()
        return [step[3] for step in path]


class Words(dict):
    """Ids of pieces that start with a space, kept by what follows it, as 32-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        byte_of = byte_letters()

        def raw(token: str) -> bytes:
            return bytes(byte_of[c] for c in token)

        pairs = [m.split(" ") if isinstance(m, str) else m for m in read["model"]["merges"]]
        added = {t["content"]: t["id"] for t in read["added_tokens"]}
        ids = {raw(t): i for t, i in read["model"]["vocab"].items() if t not in added}
        self.automaton = Automaton(ids, [(raw(u), raw(v)) for u, v in pairs])
        self.labels = self.automaton.labels | {i: t.encode() for t, i in added.items()}
        self.names = {i: str(i) for i in self.labels}
        self.special = regex.compile("|".join(sorted((regex.escape(t) for t in added), key=len, reverse=True))) if added else None
        self.added = added
        #: Letters and numbers that this library's pattern knows and the tokenizers library may not.
        known = regex.findall(r"[\p{L}\p{N}]", "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000))
        self.late = frozenset(c for c in known if unicodedata.category(c) == "Cn")
        self.bytes_of = byte_of
        self.pretokens: dict[str, bytes] = {}
        self.lines: dict[str, bytes] = {}
        self.newline = self.split_ids("\n")

    def __missing__(self, word: str) -> bytes:
        if "\n" in word and LINES.fullmatch(word):
            # a newline between other characters is a pre-token; such pieces seldom come again, their lines do
            first, *lines = word.split("\n")
            return self[first] + b"".join([self.newline + self.line(text) for text in lines])
        plain = word.rstrip(PUNCTUATION)
        if plain != word and plain and plain[-1].isalnum():
            ids = self[plain] + self.line(word[len(plain):])
        elif single(word):
            ids = self.path(" " + word)
        else:
            ids = self.split_ids(" " + word)
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[word] = ids
        return ids

    def line(self, text: str) -> bytes:
        """Ids of a piece without a space before it; none of an empty one."""
        ids = self.lines.get(text)
        if ids is None:
            ids = self.split_ids(text)
            if len(text) <= KEPT_CHARS:
                if len(self.lines) >= KEPT:
                    self.lines.clear()
                self.lines[text] = ids
        return ids

    def split_ids(self, text: str) -> bytes:
        """Ids of a part of a text, pre-token by pre-token."""
        if text.isascii() or self.late.isdisjoint(text):
            return b"".join(map(self.pretoken, PATTERN.findall(text)))
        byte_of = self.bytes_of
        return b"".join([self.pretoken(bytes(byte_of[c] for c in piece).decode()) for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text)])

    def pretoken(self, piece: str) -> bytes:
        ids = self.pretokens.get(piece)
        if ids is None:
            ids = self.path(piece)
            if len(piece) <= KEPT_CHARS:
                if len(self.pretokens) >= KEPT:
                    self.pretokens.clear()
                self.pretokens[piece] = ids
        return ids

    def path(self, piece: str) -> bytes:
        if len(self.automaton.known) >= 4 * KEPT:
            self.automaton.known.clear()
        return array("I", self.automaton.encode(piece.encode())).tobytes()

    def slices(self, text: str) -> Iterator[str]:
        """Parts of about SLICE characters, cut only where pre-tokens end anyway."""
        at = 0
        while len(text) - at > SLICE:
            found = BREAK.search(text, at + SLICE)
            if found is None:
                break
            yield text[at:found.start()]
            at = found.start()
        yield text[at:]

    def parts(self, text: str | None) -> Iterator[list[int]]:
        """Ids of a text, part by part; special strings are their own ids."""
        at = 0
        for found in self.special.finditer(text or "") if self.special else ():
            yield from self.plain(text[at:found.start()])
            yield [self.added[found[0]]]
            at = found.end()
        yield from self.plain((text or "")[at:])

    def plain(self, text: str) -> Iterator[list[int]]:
        for part in self.slices(text):
            if not part:
                continue
            if unsafe(part):
                ids = self.split_ids(part)
            else:
                # single spaces between other characters begin pre-tokens, so pieces can be looked up
                head, *others = part.split(" ")
                ids = self.split_ids(head) + b"".join(map(self.__getitem__, others))
            yield np.frombuffer(ids, np.uint32).tolist()

    def ids(self, text: str | None) -> list[int]:
        return [i for part in self.parts(text) for i in part]

    def emit(self, ids: list[int]) -> bytes:
        """Labels of the arcs taken, one after another."""
        return b"".join(map(self.labels.__getitem__, ids))


def words_of(path: str) -> Words:
    """The worker's compiled automaton of a vocabulary file."""
    if path not in _made:
        _made[path] = Words(path)
    return _made[path]


def encode_texts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids) of every row of docs (doc_id, text); a null or empty text has no ids.

    Rows keep no order and are never compared, so repeated rows and null ids give a row each.
    Other columns, whatever their names, are not read. An empty table gives an empty one.
    """
    def encoded(batches):
        own = words_of(vocabulary)
        for batch in batches:
            ids = pa.array([own.ids(t.as_py()) for t in batch.column("text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encoded, f"doc_id {kind}, ids array<int>")


def decode_ids(rows: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text, bytes that are no text U+FFFD."""
    def decoded(batches):
        own = words_of(vocabulary)
        for batch in batches:
            texts = [None if ids is None else own.emit(ids).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(decoded, f"doc_id {kind}, text string")


def round_trip_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded again part by part.

    Long texts are held once and never as a whole list of words or ids. The cases of
    ``encode_texts`` hold; no ids and no text give the digest of no bytes.
    """
    def digests(batches):
        own = words_of(vocabulary)
        for batch in batches:
            counts, hashed, decoded = [], [], []
            for value in batch.column("text"):
                ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0
                for ids in own.parts(value.as_py()):
                    ids_hash.update(("," * (n > 0) + ",".join(map(own.names.__getitem__, ids))).encode())
                    n += len(ids)
                    # parts end where pre-tokens do, hence between characters
                    text_hash.update(own.emit(ids).decode("utf-8", "replace").encode())
                counts.append(n)
                hashed.append(ids_hash.hexdigest())
                decoded.append(text_hash.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashed), pa.array(decoded)],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(digests, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
