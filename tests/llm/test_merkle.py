"""The Merkle manifest against hashlib, plain trees and its SQL."""

import hashlib
import zlib

import numpy as np
import pytest

from fieldframe.llm import merkle as M


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def shown(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes, at):
    """(top, siblings of the node ``at`` level by level as (before, after)) of a plain tree."""
    path = []
    while len(nodes) > 1:
        runs = [nodes[k:k + 3] for k in range(0, len(nodes), 3)]
        if at is not None:
            run, slot = runs[at // 3], at % 3
            path.append((run[:slot], run[slot + 1:]))
            at //= 3
        nodes = [digest(*r) for r in runs]
    return nodes[0], path


def plain(rows, tampered):
    """{(doc_id, leaf): result} of rows (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for row in rows:
        leaf = digest(*map(shown, row))
        text = tampered(row)
        trees.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf, digest(*map(shown, (*row[:4], text))), row[0]))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        trees[s].sort()
    subroots = [climb([x[2] for x in trees[s]], None)[0] for s in order]
    root, out = climb(subroots, None)[0], []
    for k, s in enumerate(order):
        leaves = [x[2] for x in trees[s]]
        above = climb(subroots, k)[1]
        for at, (_, _, leaf, value, doc_id) in enumerate(trees[s]):
            path = climb(leaves, at)[1] + above
            for before, after in path:
                value = digest(*before, value, *after)
            proof = digest(*(x for before, after in path for x in (*before, *after)))
            out.append((doc_id, leaf, subroots[k], root, proof, value, value == root))
    return sorted(out, key=str)


def cut_newlines(row):
    return row[4].replace("\n", "") if row[4] is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 else row[4]


def test_states_and_digests_equal_hashlib():
    draw = np.random.default_rng(0)
    kids = draw.integers(0, 2 ** 32, (8, 40), dtype=np.uint32)
    texts = [h.as_py() for h in M.hexes(kids)]
    for many in (0, 1, 2, 3):
        state = M.start(40)
        for k in range(many):
            state = M.resume(state, np.roll(kids, -k, axis=1), np.ones(40, bool))
        found = M.hexes(M.finish(state, np.full(40, many))).to_pylist()
        assert found == [digest(*(texts[(i + k) % 40] for k in range(many))) for i in range(40)]
    assert M.raw(M.words(M.raw(kids))) == M.raw(kids)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_trees_of_all_small_sizes_equal_plain_ones(spark, levels):
    """With one or two levels a round, both the sources' trees and the tree over them take several rounds."""
    rows = [(100 * s + k * 7 % 97, f"s{s}", "en", k, f"text {k}\n" * (k % 3)) for s, many in enumerate((1, 2, 3, 4, 9, 10, 28, 31, 82, 1, 2)) for k in range(many)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert sorted(map(tuple, M.tampered_fold(docs, levels).collect()), key=str) == plain(rows, cut_newlines)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (None, "a", None, 1, "x\ny"), (5, "a", "é", 3, ""), (5, "a", "é", 3, ""), (5, "a", "é", 3, "z\n"),
            (6, "", "en", 2, "中\n文"), (-1, "ä", "en", None, "long " * 50_000 + "\n"), (8, "z", None, 0, None), *((k, "hot", "en", k, f"t\n{k}") for k in range(2400))]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, idx int").repartition(7)
    found = sorted(map(tuple, M.tampered_fold(docs).collect()), key=str)
    assert found == plain(rows, cut_newlines)
    assert M.tampered_fold(docs.limit(0)).count() == 0
    single = M.tampered_fold(docs.where("doc_id = 8 and source = 'z'")).collect()
    assert len(single) == 1 and single[0].leaf == single[0].root and single[0].proof_sha256 == digest("") and single[0].verified


def test_manifest_holds_the_states_before_each_slot(spark, tmp_path):
    docs = spark.createDataFrame([(k, "s", "en", k, "t") for k in range(5)], "doc_id long, source string, lang string, n_chars long, text string")
    made = M.write_manifest(docs, str(tmp_path))
    row = made.trees[0].first()
    leaves = [row.digests[32 * k:32 * k + 32].hex() for k in range(5)]
    assert leaves == [digest(*map(shown, (k, "s", "en", k, "t"))) for k in range(5)]
    states = M.words(bytes(row.states))
    resumed = M.finish(M.resume(states[:, 1:2], M.words(bytes.fromhex(leaves[2])), np.ones(1, bool)), np.array([3]))
    assert M.hexes(resumed)[0].as_py() == digest(*leaves[:3]) == bytes(row.digests[160:192]).hex()
    assert all(r.verified for r in M.fold(made).collect())


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, scale):
    from oracle_check import compare, connect

    from fieldframe.llm.queries import ORACLES, QUERIES

    folder = f"/root/testdata/{scale}"
    assert compare(QUERIES["op13_merkle_manifest"](spark, folder), connect(folder), ORACLES["op13_merkle_manifest"]) is None
