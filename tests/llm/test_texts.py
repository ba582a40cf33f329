"""Toxicity, personal data, page text, language model and mixing."""

import itertools
import math
import os
import random
import zlib

import numpy as np
import plain
import pytest

from fieldframe.llm import backoff, density, mixing, pii, toxicity
from fieldframe.session import checkpoint_root

TEXTS = [None, "", " ", "write to a.b+c@mail-1.example.com, or +1 (377) 555-0271.", "4929348385146306 and 4417 7442 8035 1547 or 0000-0000-0000-00",
         "at 10.0.0.1 or 256.1.1.1, 1.2.3.4.5", "x@y.z@w.v a@b.c_d@e.f @x.y", "+1+1 (171) 555-2028 +12 34", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0", "a" * 3000 + "@" + "b" * 3000,
         "1" * 5000, "é 中 7@é.x 9@x.yé", "+49 (030) 12.34.56-78 9"]


def test_base_spans_equal_the_plain_patterns():
    draw = np.random.default_rng(3)
    made = ["".join(draw.choice(list("ab1234567890@.+- ()_\n"), size=60)) for _ in range(400)]
    for text in [t or "" for t in TEXTS] + made:
        assert pii.base_spans(text) == plain.base_spans(text), text


def test_viterbi_finds_the_best_labels():
    draw = np.random.default_rng(1)
    field = pii.Field({}, np.zeros((1, 9)), draw.normal(size=(9, 9)) + pii._forbidden())
    scores = draw.normal(size=(5, 3, 9)) * 2
    for chain, labels in zip(scores, field.decode(scores)):
        def total(path):
            steps = [0, *path, 0]
            return sum(chain[t, p] for t, p in enumerate(path)) + sum(field.step[a, b] for a, b in zip(steps, steps[1:]))
        assert math.isclose(total(tuple(labels)), max(map(total, itertools.product(range(9), repeat=3))))


def test_field_learns_what_the_patterns_miss(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    field = pii.fit(docs)
    text = "please call (377) 555-0271 today or pay with 4417.7442.8035.1547 now"
    (base, every), = pii.all_spans([text], field)
    assert base == [] and any(text[a:b].startswith("4417") for a, _, b in every)
    again = pii.fit(docs)
    assert np.array_equal(field.emit, again.emit) and np.array_equal(field.step, again.step)


def test_find_and_mask_pii(spark):
    rows = [(i, t, "r", -1, i) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "r", -1, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars long, row int")
    got = pii.find_pii(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        base = plain.base_spans(TEXTS[r.doc_id] or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, k, _ in base) for x in range(4))
        assert set(pii.listed(base).split(",")) <= set(r.spans.split(",")) | {""}
    masked = {r.doc_id: r for r in pii.mask_pii(docs).collect()}
    assert masked[0].text is None and masked[0].n_chars == 0 and masked[1].text == ""
    assert "[email]" in masked[3].text and "[phone]" in masked[3].text and masked[3].n_chars == len(masked[3].text)
    assert pii.mask_pii(docs).columns == docs.columns
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_block_max_search_is_exact():
    draw = np.random.default_rng(5)
    vectors = []
    for _ in range(400):
        terms = draw.choice(40, size=draw.integers(1, 8), replace=False)
        weights = draw.choice([0.5, 1.0, 2.0], size=len(terms))
        vectors.append({int(t): float(w) for t, w in zip(terms, weights / np.linalg.norm(weights))})
    ids = draw.permutation(400).tolist()
    index = toxicity.BlockMaxIndex(vectors, ids, [0] * 400, 40)
    for query in vectors[:60]:
        cosines, places = index.nearest(query, 7)
        scores = sorted(((-round(sum(w * v.get(t, 0.0) for t, w in query.items()), 12), i) for v, i in zip(vectors, ids)))
        want = [(-s, i) for s, i in scores if s < 0][:7]
        assert np.allclose(cosines, [s for s, _ in want])
        assert {i for s, i in want if s > want[-1][0] + 1e-9} <= set(index.ids[places].tolist())


def test_toxicity_on_held_out_rows(spark):
    draw = np.random.default_rng(0)
    plain_words, bad = [f"word{i}" for i in range(50)], ["idiot", "scumbag", "moronic"]
    rows, marks = [], []
    for i in range(600):
        own = list(draw.choice(plain_words, size=20))
        toxic = i % 5 == 0
        if toxic:
            own[3], own[7] = draw.choice(bad, 2)
        rows.append((i, " ".join(own), 0.5))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (900, None, 0.1), (901, "", 0.1), (None, "idiot scumbag", 0.1), (0, rows[0][1], 0.2)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([*marks, (None, 1), (4, None), (5, 0)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == 604
    toxic = dict(marks)
    for r in got:
        if r.doc_id is not None and r.doc_id < 900:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
            assert r.predicted == toxic[r.doc_id] and 0 <= r.score <= 1 and (r.score >= 0.3) == r.predicted
        elif r.doc_id is None:
            assert r.predicted == 1 and r.evidence
        else:
            assert r.predicted == 0 and not r.evidence
    clean = toxicity.drop_toxic(docs, labels)
    assert clean.columns == docs.columns and clean.count() == sum(r.predicted == 0 for r in got)
    assert {r.score for r in toxicity.score_documents(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_toxicity_needs_few_examples(spark):
    draw = np.random.default_rng(4)
    rows, marks = [], []
    for i in range(80):
        own = list(draw.choice([f"palabra{k}" for k in range(40)], size=20))
        if i % 8 == 0:
            own[5] = "bomenteco"
        rows.append((i, " ".join(own)))
        marks.append((i, int(i % 8 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.score_documents(docs, labels).collect()
    assert any(r.held_out and r.predicted for r in got)
    assert {r.doc_id for r in got if r.predicted} == {i for i, toxic in marks if toxic}


def test_toxicity_recall_in_every_language(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").dropDuplicates(["doc_id"]), spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.score_documents(docs, labels).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").join(labels.where("toxic is not null"), "doc_id")
    rates = {(r.lang, r.toxic): r.rate for r in got.groupBy("lang", "toxic").agg({"predicted": "avg"}).withColumnRenamed("avg(predicted)", "rate").collect()}
    assert {lang for lang, toxic in rates if toxic} == {"de", "en", "es", "fr"}
    for (lang, toxic), rate in rates.items():
        assert rate >= 0.7 if toxic else rate <= 0.05, (lang, toxic, rate)


@pytest.mark.parametrize("word_share,arc_share", [(2.5e-7, 1e-6), (1e-4, 2e-4)])
def test_automaton_equals_recursion(spark, small, monkeypatch, word_share, arc_share):
    monkeypatch.setattr(backoff, "WORD_SHARE", word_share)
    monkeypatch.setattr(backoff, "ARC_SHARE", arc_share)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.union(spark.createDataFrame([(10_001, None, ""), (10_002, "", ""), (10_003, "never seen words", "")], "doc_id long, text string, source string"))
    want = plain.backoff_scores([(r.doc_id, r.text) for r in docs.collect()], word_share, arc_share, backoff.DISCOUNT)
    got = backoff.score_texts(docs).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert math.isclose(r.base_score, w[3], abs_tol=1e-6) and math.isclose(r.score, w[4], abs_tol=1e-6)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_automaton_does_not_depend_on_what_is_broadcast(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    want = plain.backoff_scores([(r.doc_id, r.text) for r in docs.collect()], 0, 0, backoff.DISCOUNT)
    for word_share, arcs, bits in ((1e-3, 64, 16), (1.0, 1, 1 << 12)):
        monkeypatch.setattr(backoff, "WORD_SHARE", word_share)
        monkeypatch.setattr(backoff, "HOT_ARCS", arcs)
        monkeypatch.setattr(backoff, "FILTER_WORDS", bits)
        got = backoff.score_texts(docs).collect()
        assert len(got) == len(want)
        for r in got:
            w = want[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
            assert math.isclose(r.base_score, w[3], abs_tol=1e-6) and math.isclose(r.score, w[4], abs_tol=1e-6)


def test_more_text_does_not_remove_arcs(spark):
    learned = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2][:4]
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(learned[0], "the rare gem"), (learned[1], "a rare gem"), (learned[2], "the rare gem"), (held, "the rare gem")]
    want = plain.backoff_scores([*rows, (learned[3], "filler " * 3_200_000)], 0, 0, backoff.DISCOUNT)
    got = backoff.score_texts(spark.createDataFrame([*rows, (learned[3], "filler " * 3_200_000)], "doc_id long, text string")).collect()
    r = next(r for r in got if r.doc_id == held)
    assert math.isclose(r.score, want[held][4], abs_tol=1e-6) and r.score > r.base_score + 10


def test_automaton_without_training_rows(spark):
    kind = "doc_id long, text string"
    assert backoff.score_texts(spark.createDataFrame([], kind)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r, = backoff.score_texts(spark.createDataFrame([(held, "a b")], kind)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    rows = backoff.score_texts(spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], kind)).collect()
    assert len(rows) == 3 and len({r.score for r in rows}) == 1


ARTICLE = "<article><h1>A title</h1><p>First  text &amp; more.<br><p>Second <b>bold</b>\n text.</article>"
PAGES = {
    f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=x>menu</a></nav><div class='ad'>{'buy ' * 80}</div>{ARTICLE}<footer>&copy; x</footer>": "A title\nFirst text & more.\nSecond bold text.",
    "<div id=content><h1>Head</h1><div class=body><p>" + "long text here " * 20 + "</p><p>and more of it</p></div></div><div class=sidebar><p>" + "side " * 90 + "</p></div>": "Head\n" + ("long text here " * 20).strip() + "\nand more of it",
    ARTICLE.replace("</article>", "<form><input>Sign</form><div class='comments-list'><p>" + "I think so " * 50 + "</p></div></article>"): "A title\nFirst text & more.\nSecond bold text.",
    "<p>caf&eacute; &#20013;&nbsp;x</p><script>var a='</p>'</script><!-- <p>no</p> --><p hidden>gone</p>": "café 中 x",
    "": "", "<": "<", "<!-- open": "", "<script>never closed": "", "plain": "plain", "<ul><li>one<li>two</ul>": "one\ntwo",
}


@pytest.mark.parametrize("html", PAGES, ids=range(len(PAGES)))
def test_main_text(html):
    assert density.main_text(html) == PAGES[html]


def test_pages_that_are_long_or_broken():
    assert density.main_text("<p>" * 20_000 + "deep").endswith("deep")
    assert density.main_text("<div>" * 2_000 + "deep" + "</div>" * 5).endswith("deep")
    assert "x" in density.main_text("<p " + "a" * 400_000 + ">x</p>")
    assert isinstance(density.main_text('<a href="' * 3_000 + "text"), str)
    assert density.main_text("<p>a</p><a hre") == "a"


def test_extract_pages(spark):
    pages = spark.createDataFrame([(1, "u", ARTICLE, 5), (1, "u", ARTICLE, 5), (2, None, None, 5), (None, "v", "<p>x", 5)], "page_id long, url string, html string, n_chars int")
    got = sorted((r.page_id or -1, r.text, r.n_chars) for r in density.extract_pages(pages).collect())
    text = "A title\nFirst text & more.\nSecond bold text."
    assert got == [(-1, "x", 1), (1, text, len(text)), (1, text, len(text)), (2, "", 0)]
    assert density.extract_pages(pages.limit(0)).count() == 0


def test_mix_targets_and_copies(spark):
    draw = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(draw.integers(0, 30))), ["a", "b", "c", None][min(3, int(draw.integers(0, 6)))], 1) for i in range(4000)]
    docs = spark.createDataFrame([*rows, (5000, None, "a", 1), (5001, " \t", "e", 1), (None, "x y", "b", 1)], "doc_id long, text string, source string, size int")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows) + 3
    sizes, taken, target = {}, {}, {}
    for r in got:
        assert 0 <= r.copies <= 3
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
        target[r.source] = r.target
    weights = dict(zip(["a", "b", "c", "e", None], [1, 2, 3, 1, 2]))
    want, open_, left = {}, set(sizes), sum(sizes.values())
    while open_:
        share = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if share * weights[s] > 3 * sizes[s]}
        want |= {s: 3 * sizes[s] for s in full} or {s: share * weights[s] for s in open_}
        left -= sum(3 * sizes[s] for s in full)
        open_ = open_ - full if full else set()
    for s in sizes:
        assert math.isclose(target[s], want[s], rel_tol=1e-12, abs_tol=1e-9)
        assert abs(taken[s] - target[s]) <= 0.05 * target[s] + 1
    emitted = mixing.emit_mix(docs)
    assert emitted.columns == docs.columns and emitted.count() == sum(r.copies for r in got)
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert {r.target for r in mixing.mix_sources(docs.where("source = 'e'")).collect()} == {0.0}


@pytest.mark.parametrize("text,count", [("0" * 5000 + ".1.1.1", 1), ("1.2.3." + "0" * 9000, 1), ("9" * 1_000_000, 0), ("0" * 4999 + "256.1.1.1", 0), ("000.0.0.0", 1)])
def test_numbers_of_any_length_do_not_end_the_search(text, count):
    assert sum(k == 1 for _, k, _ in pii.base_spans(text)) == count


LONG = "<p>" + "many words of the text of the page here " * 20 + "</p>"


@pytest.mark.parametrize("page", [
    f"<article><form>{LONG}{LONG}<input><button>Send it</button></form></article>",
    f"<body><form><div class=nav><a href=x>Home</a></div>{LONG}{LONG}</form></body>",
    f"<main><div class='article-tags'>{LONG}{LONG}</div><form><label>Subscribe</label></form></main>",
    f"<article>{LONG}{LONG}<article><p>Send your remark</p></article></article>",
    f"<main>{LONG}{LONG}<div class=comments>{LONG.replace('words', 'Send')}</div></main>",
])
def test_density_decides_inside_forms_and_named_elements(page):
    main_text = density.main_text

    block = " ".join(LONG[3:-4].split())
    assert main_text(page) == f"{block}\n{block}"


def test_density_sums_equal_recursion():
    NAMED, Page = density.NAMED, density.Page

    draw = random.Random(5)

    def tree(depth):
        tag = draw.choice(["div", "p", "a", "span", "section", "form", "div class=menu"])
        inner = "".join(tree(depth - 1) for _ in range(draw.randint(0, 3))) if depth else ""
        return f"<{tag}>{'word ' * draw.choice([0, 1, 5, 40])}{inner}</{tag.split()[0]}>"

    for _ in range(40):
        page = Page("".join(tree(4) for _ in range(3)))
        _, total = page.densities()
        texts = [(n, t) for t, n in zip(page.pieces, page.owner) if t is not None]
        assert total == pytest.approx(plain.density_sums(page.tag, page.parent, page.doubt, texts, NAMED), rel=1e-6)


def test_block_max_index_of_counts_is_small_and_exact():
    draw = np.random.default_rng(6)
    scale = draw.random(3000) ** 8  # most terms tell little, so what is left out matters
    bags = [(np.sort(draw.choice(3000, size=200, replace=False)).astype(np.int32), draw.integers(1, 30, 200)) for _ in range(600)]
    bags += [(np.array([2999], np.int32), np.array([2])), bags[0]]
    starts, of, counts = np.cumsum([0, *(len(t) for t, _ in bags)]), np.concatenate([t for t, _ in bags]), np.concatenate([n for _, n in bags])
    plain = np.zeros((len(bags), 3000))
    for row, (terms, many) in zip(plain, bags):
        row[terms] = (1 + np.log(many)) * scale[terms]
    plain /= np.linalg.norm(plain, axis=1)[:, None]
    index = toxicity.BlockMaxIndex((starts, of, counts), list(range(len(bags))), [0] * len(bags), 3000, scale)
    assert sum(v.nbytes for v in vars(index).values() if isinstance(v, np.ndarray) and v.dtype == np.float64 and len(v) > 3000) == 0
    least = int(np.flatnonzero(plain[3])[np.argmin(plain[3][plain[3] > 0])])
    queries = [row for row in plain[:40]] + [np.eye(3000)[least], np.eye(3000)[2999]]  # the last ones have a single term
    vectors = [(np.flatnonzero(q), q[q > 0]) for q in queries]
    for query, (cosines, places) in zip(queries, index.nearest_of(vectors, 15)):
        want = plain @ query
        best = np.sort(want[want > 0])[::-1][:15]
        assert np.allclose(cosines, best, rtol=1e-9, atol=0) and len(set(places.tolist())) == len(best)
        assert np.allclose(want[index.ids[places]], best, rtol=1e-9, atol=0)


def test_packed_blocks_of_keys():
    draw = np.random.default_rng(5)
    for n, low, high, places in ((1, 0, 2**63, 1), (1, 0, 1, 1), (5, 7, 8, 1), (4000, 0, 2**63, 90_000), (4000, 2**62, 2**62 + 9000, 200)):
        keys, at = np.sort(draw.integers(low, high, n).astype(np.uint64)), draw.integers(0, places, n)
        packed = backoff._packed(keys, at)
        back, there = backoff._unpacked(*packed, n)
        assert np.array_equal(back, keys) and np.array_equal(there, at)
    assert len(packed[0]) + len(packed[1]) <= 8 + 3 * n


def test_automaton_keeps_only_its_values_on_disk(spark, small):
    """Counts and shares of n-grams are deleted once the values that texts look up are written."""
    folder = f"{checkpoint_root(spark)}/fieldframe"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    backoff.score_texts(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")).count()
    assert {f.rpartition("-")[0] for f in set(os.listdir(folder)) - before} == {"words", "pair_values", "triple_values"}
