"""The tokenization automaton against plain merging, small vocabularies and the tokenizers library."""

import hashlib
import random

import pytest

from fieldframe.llm import merge_automaton as A


def merged(word, merges):
    """Ids as byte strings by merging in order, the leftmost pair of the earliest merge first."""
    parts = [bytes([b]) for b in word]
    rank = {m: k for k, m in enumerate(merges)}
    while True:
        found = [(rank[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in rank]
        if not found:
            return parts
        _, k = min(found)
        parts[k:k + 2] = [parts[k] + parts[k + 1]]


@pytest.mark.parametrize("seed", range(12))
def test_small_vocabularies_equal_plain_merging(seed):
    draw = random.Random(seed)
    letters = [bytes([b]) for b in b"abc"[:2 + seed % 2]]
    known, merges = list(letters), []
    while len(merges) < 14:
        u, v = draw.choice(known), draw.choice(known)
        if u + v not in known and len(u + v) < 9:
            known.append(u + v)
            merges.append((u, v))
    own = A.Automaton({t: i for i, t in enumerate(known)}, merges)
    for _ in range(600):
        word = bytes(draw.choice(b"abc"[:2 + seed % 2]) for _ in range(draw.randint(1, 24)))
        assert [own.labels[i] for i in own.encode(word)] == merged(word, merges), (merges, word)


def test_a_dead_merge_adds_no_arc():
    """abc can only become a, bc: the merge of ab and c is never reached."""
    ids = {t: i for i, t in enumerate([b"a", b"b", b"c", b"bc", b"ab", b"abc"])}
    own = A.Automaton(ids, [(b"b", b"c"), (b"a", b"b"), (b"ab", b"c")])
    assert [own.labels[i] for i in own.encode(b"abc")] == [b"a", b"bc"] and ids[b"abc"] not in own.made


@pytest.fixture(scope="module")
def own(vocabulary):
    return A.words_of(vocabulary)


def test_ids_equal_the_library(own, monkeypatch):
    draw = random.Random(5)
    odd = ["", " ", "a", "  a", "a   b", "don't 'tis it's'll", "<|endoftext|>", "x<|endoftext|> <|endoftext|>y", "\x1c \x1f\x85 a", "Ⅷ ½², 中文 字。",
           "ᲊ ᲊa 1ᲊ", "a\U00010940b \U00010941", "a" * 5000, "ab" * 3000, " " * 999, "\n" * 50 + " x", "é é é", "1" * 700, "퟿\U0010ffff"]
    made = ["".join(draw.choices("ab éthe in'st re1234 \n\t中文字Ⅷ½", k=60)) for _ in range(400)]
    made += ["".join(chr(draw.choice([draw.randint(32, 0x2FFF), draw.randint(0x10000, 0x1FFFF)])) for _ in range(30)) for _ in range(400)]
    for size in (1 << 20, 7):
        monkeypatch.setattr(A, "SLICE", size)
        for text in odd + made:
            ids = own.ids(text)
            assert ids == own.library.encode(text, add_special_tokens=False).ids, repr(text)
            assert own.emit(ids).decode() == own.library.decode(ids, skip_special_tokens=False) == text
    assert own.ids(None) == []


def test_words_that_are_not_kept(own, monkeypatch):
    monkeypatch.setattr(A, "KEPT", 3)
    for text in ("one two three four five six one two", "a " * 300):
        assert own.ids(text) == own.library.encode(text, add_special_tokens=False).ids
    assert len(own) <= 3


def test_digests_of_odd_tables(spark, own, vocabulary):
    rows = [(1, "one two, three", "x", 5), (1, "one two, three", "x", 5), (None, "", "y", 1), (3, None, None, None), (4, "word " * 30_000, "z", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    found = sorted(A.round_trip_digests(docs, vocabulary).collect(), key=lambda r: (r.doc_id or 0))
    want = []
    for i, text, *_ in rows:
        ids = own.library.encode(text or "", add_special_tokens=False).ids
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((i, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()))
    assert [tuple(r) for r in found] == sorted(want, key=lambda r: r[0] or 0)
    encoded = A.encode_texts(docs, vocabulary)
    assert sorted((r.doc_id or 0, r.text) for r in A.decode_ids(encoded, vocabulary).collect()) == sorted((i or 0, t or "") for i, t, *_ in rows)
    nulls = spark.createDataFrame([(1, None), (2, [300])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in A.decode_ids(nulls, vocabulary).collect()} == {1: None, 2: own.library.decode([300])}
    assert A.round_trip_digests(docs.limit(0), vocabulary).count() == 0


def test_query_equals_the_library_on_all_documents(spark, small, vocabulary):
    from fieldframe.llm.queries import QUERIES

    library = A.words_of(vocabulary).library
    found = {r.doc_id: r for r in QUERIES["op11_merge_automaton"](spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        r = found[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
