"""Pairs that share as many segments as linked ones must, against a plain loop; unlike texts stay apart."""

import random
from itertools import combinations

import numpy as np
import plain
import pyarrow as pa
import pytest

from fieldframe.llm import ngram_join, words
from test_pairs import made_texts


@pytest.mark.parametrize("limit,batch", [(128, 1000), (4, 1000), (4, 3), (128, 3)])
def test_pairs_of_hashes(limit, batch):
    draw = random.Random(2)
    groups = {g: sorted({draw.randrange(500) for _ in range(draw.choice([2, 3, 4, 5, 9]))}) for g in range(40)}
    least = {c: draw.randrange(1, 9) for c in range(500)}
    rows = [(g, c, least[c], of[0], least[of[0]]) for g, of in groups.items() for c in of[1:] for _ in range(draw.choice([1, 1, 2]))]
    table = pa.table([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.int8()])], ["seg", "cls", "least", "v", "of_v"])
    got = {tuple(r.values()) for b in ngram_join._near(limit)(table.to_batches(batch)) for r in b.to_pylist()}
    want = set()
    for of in groups.values():
        want |= {(c, of[0], 0) for c in of[1:]} if len(of) > limit else {(b, a, min(least[a], least[b])) for a, b in combinations(of, 2)}
    assert got == want


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_linked_pairs_share_enough_segments(size, percent):
    sets = [words.shingle_set(h, size) for h in (words.word_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for t in made_texts(600) if t and t.strip())]
    cut, some = ngram_join.Segments(percent), 0
    filed = [dict(zip(*(x.tolist() for x in cut.filed(s)))) for s in sets]
    for (a, f), (b, g) in combinations(zip(sets, filed), 2):
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
            shared = f.keys() & g.keys()
            assert len(shared) >= min(min(f[k], g[k]) for k in shared)
            some += 1
    assert some > 20


def passages(n=240):
    """Texts that share passages with others, but none with a linked one."""
    draw = random.Random(7)
    fixed = [" ".join(f"p{i}w{k}" for k in range(14)) for i in range(12)]
    return [f"{draw.choice(fixed)} " + " ".join(f"t{i}w{k}" for k in range(30)) + f" {draw.choice(fixed)}" for i in range(n)]


def test_shared_passages_make_no_common_block(spark, monkeypatch):
    """Else all texts of a corpus with common passages fall into one block, and its chunks meet all others."""
    sizes = []
    grouped = ngram_join._bit_filter
    monkeypatch.setattr(ngram_join, "_bit_filter", lambda blocks: sizes.append(blocks.count()) or grouped(blocks))
    rows = list(enumerate(passages()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ngram_join.keep_one(docs, 5, 80).count() == len(rows)
    assert sizes[0] < len(rows) // 2


@pytest.mark.parametrize("paired", [128, 3])
@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_join_equals_all_pairs_on_either_way(spark, monkeypatch, paired, size, percent):
    monkeypatch.setattr(ngram_join, "PAIRED", paired)
    rows = list(enumerate(made_texts(400) + passages(40)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs, size, percent).collect()}
    assert got == plain.jaccard_components(rows, size, percent)


def test_hot_hashes_make_no_common_block(spark, monkeypatch):
    """Else the larger a corpus, the more of its unlike texts fall into one block."""
    monkeypatch.setattr(ngram_join, "PAIRED", 3)
    sizes = []
    grouped = ngram_join._bit_filter
    monkeypatch.setattr(ngram_join, "_bit_filter", lambda blocks: sizes.append(blocks.count()) or grouped(blocks))
    rows = list(enumerate(passages()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ngram_join.keep_one(docs, 5, 80).count() == len(rows)
    assert sizes[0] < len(rows) // 2


def test_sketches_never_differ_more_than_their_sets():
    draw = np.random.default_rng(3)
    for n in (0, 1, 30, 700):
        common, a, b = (words.mix(draw.integers(0, 2**63, k).astype(np.uint64)) for k in (50, n, n // 2))
        x, y = (ngram_join.parity_sketch(np.union1d(common, s)) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_classes_of_a_hot_hash_meet_as_sizes_and_sketches_allow(monkeypatch):
    monkeypatch.setattr(ngram_join, "MET", 50)
    draw = np.random.default_rng(5)
    base = [words.mix(draw.integers(0, 2**63, k).astype(np.uint64)) for k in (40, 60, 60, 200)]
    sets = [np.unique(np.concatenate((b[int(draw.integers(0, 4)):], words.mix(draw.integers(0, 2**63, 2).astype(np.uint64))))) for b in base for _ in range(10)]
    rest = draw.random(len(sets)) < 0.5
    sketches = np.array([ngram_join.parity_sketch(s) for s in sets])
    columns = {"task": pa.array([i % 2 for i in range(40)]), "cls": pa.array(range(40), pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "rest": pa.array(rest)}
    table = pa.table(columns | {c: pa.array(x.view(np.int64)) for c, x in zip(ngram_join.SKETCH, np.ascontiguousarray(sketches.T))}).sort_by("task")
    found = [(r["u"], r["v"]) for b in ngram_join._met(80)(table.to_batches(7)) for r in b.to_pylist()]
    want = [(i, j) for i in range(40) for j in range(40) if i != j and i % 2 == j % 2 and (rest[i] or rest[j])
            and 80 * max(len(sets[i]), len(sets[j])) <= 100 * min(len(sets[i]), len(sets[j]))
            and 180 * np.bitwise_count(sketches[i] ^ sketches[j]).sum() <= 20 * (len(sets[i]) + len(sets[j]))]
    assert plain.components(range(40), found) == plain.components(range(40), want)
    assert len(want) < 40 * 39 // 2


def test_unlike_texts_of_hot_hashes_only_make_no_common_block(spark, monkeypatch):
    """Texts of common passages, of which nearly every hash is hot; blocks of them grew faster than a corpus."""
    monkeypatch.setattr(ngram_join, "PAIRED", 3)
    draw = random.Random(11)
    fixed = [" ".join(f"p{i}w{k}" for k in range(14)) for i in range(12)]
    texts = [" ".join(draw.sample(fixed, 3)) for _ in range(150)]
    copies = [f"{t} end" for t in texts[:20]]
    sizes = []
    grouped = ngram_join._bit_filter
    monkeypatch.setattr(ngram_join, "_bit_filter", lambda blocks: sizes.append(blocks.count()) or grouped(blocks))
    rows = list(enumerate(texts + copies))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs, 5, 80).collect()}
    assert got == plain.jaccard_components(rows, 5, 80)
    assert sizes[0] < len(rows) // 2


@pytest.mark.parametrize("chunk", [8192, 2])
def test_join_of_hot_hashes_dealt_out_equals_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "PAIRED", 1)
    monkeypatch.setattr(ngram_join, "HOT_CHUNK", chunk)
    rows = list(enumerate(made_texts(400) + passages(40)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs, 3, 90).collect()}
    assert got == plain.jaccard_components(rows, 3, 90)
