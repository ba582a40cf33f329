"""Shingle joins, vector near-copies, neighbours and components against all pairs."""

import random

import numpy as np
import plain
import pyarrow as pa
import pytest

from fieldframe.llm import batches, curves, graph, lattice, ngram_join, words


def test_word_hashes_split_like_the_pattern():
    texts = ["Ab  ab\tAB", None, "", " \n ", "é É x y", "a" * 5000 + " b"]
    seen = {}
    for first, end, data, bounds in words.text_slices(pa.array(texts), limit=20):
        hashes, at = words.word_hashes(data, bounds)
        for row in range(first, end):
            own = hashes[at[row - first]:at[row - first + 1]].tolist()
            found = plain.words(texts[row])
            assert len(own) == len(found)
            for w, h in zip(found, own):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def made_texts(n=160):
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(draw.choice(vocabulary) for _ in range(draw.choice([1, 2, 3, 9, 12, 30, 120]))) for _ in range(n // 2)]
    for _ in range(n // 2):
        own = draw.choice(texts).split(" ")
        for _ in range(draw.choice([0, 0, 1, 1, 2, 4])):
            own[draw.randrange(len(own))] = draw.choice(vocabulary)
        texts.append(" ".join(own) if draw.random() < 0.8 else " ".join(own).upper())
    return [*texts, None, "", " \t\n", "one", "One", "one two"]


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_segments_keep_every_linked_pair(size, percent):
    sets = [words.shingle_set(h, size) for h in (words.word_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for t in made_texts() if t and t.strip())]
    cut = ngram_join.Segments(percent)
    marks = [set(cut.of(s).tolist()) for s in sets]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
                assert marks[i] & marks[j]


def test_trees_link_what_all_pairs_link():
    sets = [words.shingle_set(words.word_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0], 3) for t in made_texts(300) if t and t.strip()]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])
             if 10 * (both := len(np.intersect1d(a, b))) >= 9 * (len(a) + len(b) - both)]
    assert plain.components(range(len(sets)), ngram_join.linked(sets, 90)) == plain.components(range(len(sets)), links)


@pytest.mark.parametrize("chunk", [1024, 2])
def test_ngram_join_equals_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK_SETS", chunk)
    rows = list(enumerate(made_texts()))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, cls string, n int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs, 3, 90).collect()}
    assert got == plain.jaccard_components(rows, 3, 90)


def test_ngram_join_of_repeated_null_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(7, text), (7, text), (None, text), (3, text.upper()), (9, None), (9, "")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs).collect())
    assert got == [(-1, 18, 3), (3, 18, 3), (7, 18, 3), (7, 18, 3), (9, 0, 9), (9, 0, 9)]
    assert ngram_join.ngram_join(docs.limit(0)).count() == 0
    kept = sorted((r.doc_id or -1) for r in ngram_join.keep_one(docs).collect())
    assert kept == [-1, 3, 9, 9]
    assert ngram_join.keep_one(docs.limit(0)).columns == docs.columns


@pytest.mark.parametrize("per_task", [1 << 20, 40])
def test_components(spark, per_task):
    draw = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(draw.randrange(100, 300), draw.randrange(100, 300)) for _ in range(120)] + [(400, 400), (5, 6)]
    got = dict(graph.components(spark.createDataFrame(links, "u long, v long"), per_task).collect())
    want = plain.components({x for a, b in links if a != b for x in (a, b)}, links[:-2])
    assert got == want
    assert graph.components(spark.createDataFrame([], "u long, v long"), per_task).count() == 0


def test_e8_point_is_the_nearest():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(300, 8)) * 2
    near = lattice.e8_points(x, 4) / 2
    assert np.all((near.sum(axis=2) * 1.0) % 2 == 0)
    own = ((near[:, 0] - x) ** 2).sum(axis=1)
    assert own.max() <= 1 + 1e-9  # the covering radius
    steps = np.array([s for s in np.stack(np.meshgrid(*[[-1, 0, 1]] * 8), -1).reshape(-1, 8) if abs(s).sum() == 2])
    halves = np.stack(np.meshgrid(*[[-0.5, 0.5]] * 8), -1).reshape(-1, 8)
    around = np.concatenate([steps, halves[(halves < 0).sum(axis=1) % 2 == 0]])
    for point, vector, d in zip(near[:60, 0], x, own):
        assert d <= ((point + around - vector) ** 2).sum(axis=1).min() + 1e-9


def made_vectors():
    draw = np.random.default_rng(2)
    base = draw.normal(size=(150, 16))
    near = base[draw.integers(0, 150, 150)] + draw.normal(size=(150, 16)) * 0.05
    far = [[float(c) for c in v] for v in np.concatenate([base, near, base[:5], near[:3] * 3])]
    rows = [(i, v, i % 2) for i, v in enumerate(far)]
    odd = [None, [0.0] * 16, [float("nan")] * 16, [float("inf"), *[1.0] * 15], [None, *[1.0] * 15], [1.0, 2.0], []]
    rows += [(1000 + 2 * i, v, 0) for i, v in enumerate(odd)] + [(2000, far[0], None), (2002, far[1], None), (1, far[1], 1)]
    return rows


def test_a_vector_comes_once_to_a_table(spark):
    """Before, it was dealt out with every cell that it shared."""
    codes = list(range(lattice.TABLES * lattice.PROBES))
    files = spark.createDataFrame([(0, k, 1, codes, [1.0, 0.0]) for k in range(5)], "label long, cls long, copies long, codes array<long>, embedding array<float>")
    got = lattice._dealt(files, None).groupBy("cls", "task").count().collect()
    assert len(got) == 5 * lattice.TABLES and {r["count"] for r in got} == {1}


@pytest.mark.parametrize("rows", [75_000, 20])
@pytest.mark.parametrize("chunk", [1024, 2])
def test_lattice_of_parts_equals_all_pairs(spark, monkeypatch, chunk, rows):
    monkeypatch.setattr(lattice, "TASK_ROWS", rows)
    test_lattice_links_equal_all_pairs(spark, monkeypatch, chunk)


@pytest.mark.parametrize("chunk", [1024, 2])
def test_lattice_links_equal_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(lattice, "CHUNK", chunk)
    rows = made_vectors()
    frame = spark.createDataFrame([(i, v, l, 0, "x") for i, v, l in rows], "vec_id long, embedding array<float>, label int, cls int, code string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice.near_copies(frame).collect())
    good = [k for k, (_, v, l) in enumerate(rows) if l is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    unit = {k: (x := np.array(np.array(rows[k][1], np.float32), float)) / np.linalg.norm(x) for k in good}
    links = [(a, b) for a in good for b in good if a < b and rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= 0.98]
    count = {k: sum(k in pair for pair in links) for k in range(len(rows))}
    root = plain.components(range(len(rows)), links)
    least = {}
    for k in range(len(rows)):
        least[root[k]] = min(least.get(root[k], 1 << 60), rows[k][0])
    assert got == sorted((rows[k][0], count[k], least[root[k]], rows[k][0] == least[root[k]]) for k in range(len(rows)))


def test_close_pairs_of_many_cells_equal_single_ones(monkeypatch):
    monkeypatch.setattr(lattice, "COSINES", 40)
    monkeypatch.setattr(lattice, "PAIRS", 3)
    draw = np.random.default_rng(6)
    sizes = np.array([2, 1, 5, 2, 3, 9, 2, 1, 3])
    unit = lattice.unit_vectors(draw.normal(size=(4, 8))[draw.integers(0, 4, sizes.sum())] + draw.normal(size=(sizes.sum(), 8)) * 0.05)
    cell = np.repeat(np.arange(len(sizes)), sizes)
    rows, found = draw.permutation(len(unit)), []
    place = np.argsort(rows)
    for x, y, at in lattice.close_pairs(unit[place], rows, sizes, 0.98):
        assert ((np.cumsum(sizes) - sizes)[cell[place[x]]] == at).all()
        found += zip(place[x].tolist(), place[y].tolist())
    want = [(a, b) for a in range(len(unit)) for b in range(a + 1, len(unit)) if cell[a] == cell[b] and unit[a] @ unit[b] >= 0.98]
    assert sorted(found) == want and 3 < len(want) < sizes.sum()
    codes = np.sort(draw.integers(0, 30, (len(unit), 6)), axis=1)
    a, b = np.array(want).T
    limit = draw.integers(0, 30, len(want))
    met = [any(c < k for c in set(codes[x]) & set(codes[y])) for x, y, k in zip(a, b, limit)]
    assert lattice.met_before(codes, a, b, limit).tolist() == met and any(met) and not all(met)


@pytest.mark.parametrize("batch", [1, 3, 4, 100])
def test_whole_runs(batch):
    keys = [1, 1, 1, 2, 3, 3, 3, 3, 3, 7, 8, 8]
    table = pa.table({"k": keys, "x": range(len(keys))})
    parts = [p.column("k").to_pylist() for p in batches.whole_runs(iter(table.to_batches(batch)), "k")]
    assert sum(parts, []) == keys
    assert all(not set(a) & set(b) for a, b in zip(parts, parts[1:]))


def test_lattice_of_no_rows(spark):
    assert lattice.near_copies(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_curves_equal_brute_force_with_the_whole_window(spark):
    rows = [(i, v, 0, "q") for i, v, _ in made_vectors()]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, query_id string")
    got = [tuple(r) for r in curves.nearest(frame, k=4, every=50, window=2.0).orderBy("query_id", "rank").collect()]
    points = [(i, np.array(np.array(v, np.float32), float)) for i, v, *_ in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    want = []
    for q, x in sorted((p for p in points if p[0] % 50 == 0), key=lambda p: p[0]):
        best = {}
        for i, y in points:
            if i != q:
                best[i] = min(best.get(i, np.inf), float(np.sqrt(((x - y) ** 2).sum())))
        want += [(q, k + 1, i, d) for k, (d, i) in enumerate(sorted((d, i) for i, d in best.items())[:4])]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)


def test_curves_without_rows_or_candidates(spark):
    kind = "vec_id long, embedding array<float>"
    assert curves.nearest(spark.createDataFrame([], kind)).count() == 0
    assert curves.nearest(spark.createDataFrame([(0, [1.0, 2.0])], kind)).count() == 0
    assert curves.nearest(spark.createDataFrame([(0, [1.0, 2.0]), (5, [1.0, 3.0])], kind)).count() == 1


def test_curves_recall(spark, small):
    from fieldframe.llm.queries import QUERIES

    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = {}
    for r in QUERIES["op3_shifted_curves"](spark, small).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    shares = []
    for q in np.flatnonzero(ids % 100 == 0):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        shares.append(len(found[ids[q]] & set(ids[np.argsort(d)[:10]].tolist())) / 10)
    assert np.mean(shares) >= 0.9


def test_hilbert_curve_steps_to_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    keys = curves.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
