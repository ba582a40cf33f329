"""Tokens, packing, token files, registered queries and the pipeline."""

import collections
import zlib

import numpy as np
import pytest

from fieldframe.llm import packing, token_files, tokens, toxicity

ODD = ["", "a", "  a", "a  b", "a   b", "a \n b", "a\n  b", "x\t y", " lead", "trail ", "trail  ", "don't stop", "it's. 'tis ", "<|endoftext|> x",
       "a\x1cb !\x1c! c", "½ ²x a²,", "Ⅷ, naïve. 中文 字。", "\n\n a", "a  b", "　 x a", "é é. a", "10,000. 5% x.!", "word. Word, WORD! word?"]


def test_ids_equal_the_library(vocabulary):
    own = tokens.Encoder(vocabulary)
    draw = np.random.default_rng(1)
    made = ["".join(draw.choice(list("ab A.,!?'1 \n\té中"), size=40)) for _ in range(300)]
    for text in ODD + made:
        assert own.ids(text).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert own.ids(None).tolist() == []


@pytest.mark.parametrize("limits,window,longest", [(packing.Limits(), 512, 5000), (packing.Limits(64, 3, 40), 16, 150)])
def test_packer_keeps_limits_and_all_ids(limits, window, longest):
    draw = np.random.default_rng(0)
    packer, docs, done = packing.Packer(limits, window), {}, []
    for i in range(600):
        n = int(draw.integers(1, longest))
        docs[i] = draw.integers(0, 9, n).astype("<u4")
        done += packer.add(packing.Piece(i, 0, docs[i], None if i % 2 else draw.random(n) < 0.5, n))
    done += packer.close()
    parts = collections.defaultdict(list)
    for pieces in done:
        total = sum(len(p.ids) for p in pieces)
        assert total == limits.tokens or total & (total - 1) == 0
        assert len(pieces) <= limits.segments and sum(p.loss for p in pieces) <= limits.loss
        for p in pieces:
            parts[p.doc_id].append(p)
    assert set(parts) == set(docs)
    for i, found in parts.items():
        assert np.array_equal(np.concatenate([p.ids for p in sorted(found, key=lambda p: p.start)]), docs[i])


def test_pack_documents(spark, vocabulary):
    own = tokens.Encoder(vocabulary)
    texts = [None, "", "one two", "word " * 9000, *(f"text number {i}" for i in range(50))]
    docs = spark.createDataFrame([(i, t, 4, "s") for i, t in enumerate(texts)] + [(2, "one two", 4, "s"), (None, "x", None, "s")], "doc_id long, text string, length int, start string").repartition(3)
    rows = packing.pack_documents(docs, vocabulary).collect()
    by_sequence, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 2048 or at & (at - 1) == 0
    for i, text in enumerate(texts):
        ids = np.append(own.ids(text), np.array([1], "<u4"))
        assert sum(p.length for p in by_doc[i]) == len(ids) * (1 + (i == 2))
        for p in by_doc[i]:
            assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes()) and p.doc_tokens == len(ids)
    assert by_doc[None][0].doc_tokens == len(own.ids("x")) + 1
    with_prompt = packing.pack_documents(docs, vocabulary, prompt_chars="length").collect()
    assert sum(r.loss_tokens for r in with_prompt) < sum(r.length for r in with_prompt)
    assert packing.pack_documents(docs.limit(0), vocabulary).count() == 0


def test_byte_codes_round_trip():
    draw = np.random.default_rng(0)
    for top in (1, 300, 70_000, 1 << 25, (1 << 32) - 1):
        for n in (0, 1, 3, 4, 1001):
            ranks = draw.integers(0, top, n, endpoint=True).astype(np.uint32)
            control, data = token_files.encode_ranks(ranks)
            assert len(control) == -(-n // 4)
            assert np.array_equal(token_files.decode_ranks(control, data, n), ranks)


def test_token_files_round_trip(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 64)
    own = tokens.Encoder(vocabulary)
    texts = {i * 3 % 101: t for i, t in enumerate([None, "", *(f"text {i} " * (i + 1) for i in range(40))])}
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, start int").repartition(4)
    rows = sorted(token_files.tokens_round_trip(docs, vocabulary).collect())
    at = 0
    for r, i in zip(rows, sorted(texts), strict=True):
        ids = np.append(own.ids(texts[i]), np.array([0], "<u4"))
        assert tuple(r) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    again = docs.union(docs.where("doc_id < 10")).union(spark.createDataFrame([(None, "x", 0)], docs.schema))
    starts = sorted((r.start, r.n_tokens) for r in token_files.tokens_round_trip(again, vocabulary).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and len(starts) == again.count()
    assert token_files.tokens_round_trip(docs.limit(0), vocabulary).count() == 0


def test_every_operator_has_one_query():
    from fieldframe.llm.queries import ORACLES, QUERIES

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) == {"op5_mix_sources", "op13_merkle_manifest"}


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_mix_equals_its_sql(spark, scale):
    from oracle_check import compare, connect

    from fieldframe.llm.queries import ORACLES, QUERIES

    folder = f"/root/testdata/{scale}"
    assert compare(QUERIES["op5_mix_sources"](spark, folder), connect(folder), ORACLES["op5_mix_sources"]) is None


def test_pipeline_stages(spark, small):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rejected = {r.doc_id for r in toxicity.score_documents(docs, labels).where("predicted = 1").collect()}
    stages = dict(P.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard_join", "pii", "mixing", "packing"]
    clean = stages["toxicity"](spark, docs, small)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(before) - rejected
    import plain

    single = stages["ngram_jaccard_join"](spark, clean, small)
    roots = plain.jaccard_components([(i, r.text) for i, r in before.items() if i not in rejected], 5, 80)
    assert {r.doc_id for r in single.collect()} == {i for i, (n, root) in roots.items() if i == root}
    masked = stages["pii"](spark, single, small)
    assert masked.columns == docs.columns and masked.count() == single.count()
    mixed = stages["mixing"](spark, masked, small)
    assert mixed.columns == docs.columns and 0 < mixed.count() <= 3 * masked.count()
    packed = P.run(spark, small).collect()
    assert packed and {r.doc_id for r in packed} <= {r.doc_id for r in masked.collect()}
