"""The automaton's tables by ranges of keys."""

import math
import tracemalloc

import numpy as np
import plain
import pyarrow as pa

from fieldframe.llm import backoff
from fieldframe.llm.words import BASE, STEPS, mix, unmix


def test_automaton_moves_ranges_not_rows(spark, small):
    """Tables have one row for a range of keys, and ranges hold about equal numbers of keys whatever words are frequent."""
    texts = spark.read.parquet(f"{small}/documents.parquet").select("text")
    often = spark.createDataFrame([("so " * 50 + f"so w{i} so v{i}",) for i in range(2000)], "text string")
    model = backoff.fit(texts.union(often).union(often))
    assert model.words.count() <= 1 << model.bits and model.arcs.count() <= 2 << model.bits
    for table in (model.words, model.arcs.where("kind = 1"), model.arcs.where("kind = 2")):
        sizes = [r.n for r in table.select("n").collect()]
        assert sum(sizes) > 4000 and max(sizes) < 2 * sum(sizes) / (1 << model.bits)


def test_automaton_does_not_depend_on_the_number_of_ranges(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    want = plain.backoff_scores([(r.doc_id, r.text) for r in docs.collect()], 0, 0, backoff.DISCOUNT)
    monkeypatch.setattr(backoff, "RANGE_TOKENS", 300)
    monkeypatch.setattr(backoff, "HOT_ARCS", 1)
    got = backoff.score_texts(docs).collect()
    assert len(got) == len(want) and all(math.isclose(r.score, want[r.doc_id][4], abs_tol=1e-6) for r in got)


def test_task_counts_in_bounded_memory():
    """A task's memory follows its buffer, not the number of words it reads."""
    draw = np.random.default_rng(3)
    text = pa.array([" ".join(f"{w:x}" for w in draw.integers(0, 1 << 30, 1000)) for _ in range(2500)])

    def part(tokens, starts):
        return [(backoff.WORD, tokens, None), (backoff.PAIR, backoff.pair_ids(*backoff.pairs_of(tokens, starts)), tokens)]

    tracemalloc.start()
    try:
        words = sum(r.n for batch in backoff._buffered([pa.RecordBatch.from_arrays([text], ["text"])], 5, part) for r in backoff._rows([batch]) if r.kind == backoff.WORD)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert words > 2_000_000 and peak < 130e6


def test_hashes_can_be_undone():
    x, y = np.random.default_rng(4).integers(0, 2**63, (2, 1000)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    assert np.array_equal(unmix(mix(x)), x)
    assert np.array_equal(backoff.first_of(backoff.pair_ids(x, y), y, BASE), x)
    assert np.array_equal(backoff.first_of(backoff.triple_ids(x, y), y, STEPS[0]), x)
