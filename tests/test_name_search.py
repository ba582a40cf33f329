"""Most similar names by the letter index against comparing every pair."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from fieldframe.operators import crosswalk as K
from fieldframe.operators import name_search as S
from fieldframe.plans import crosswalk_queries as KQ


def plain(target, names):
    best = None
    for name, code in names:
        score = SequenceMatcher(None, target, name).ratio()
        if score > 0 and (best is None or (-score, code) < best):
            best = (-score, code)
    return None if best is None else (-best[0], best[1])


def misspelt(draw, text):
    out = list(text)
    for _ in range(draw.randint(0, 2)):
        at = draw.randrange(len(out) + 1)
        out[at:at + draw.randint(0, 1)] = draw.choice(["", "x", "a", "州"])
    return "".join(out)


@pytest.mark.parametrize("chunk", [4096, 7])
def test_closest_names_equal_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(S, "CHUNK", chunk)
    draw = random.Random(chunk)
    texts = ["".join(draw.choices("abcd安徽州南北", k=draw.randint(1, 9))) for _ in range(60)]
    names = [(s, y, n, f"{draw.randint(0, 30):03}") for s in ("p", "q", None) for y in (1998, None) for n in draw.sample(texts, 40)]
    targets = [(s, y, misspelt(draw, t)) for s in ("p", "q", None, "nowhere") for y in (1998, None) for t in draw.sample(texts, 15)]
    targets += [("p", 1998, "zz"), ("p", 1998, ""), ("p", 1998, texts[0] * 50), ("q", None, None)]
    left = spark.createDataFrame(targets, "s string, y int, t string").distinct()
    right = spark.createDataFrame(names + [("p", 1998, None, "0"), ("p", 1998, "zz", None)], "scope string, year int, n string, c string")
    found = S.closest_names(left, right, {"s": "scope", "y": "year"}, "t", "n", "c").collect()
    want = {}
    for s, y, t in set(targets):
        best = plain(t, [(n, c) for a, b, n, c in names if (a, b) == (s, y)]) if t is not None else None
        if best:
            want[s, y, t] = best
    assert {(r.s, r.y, r.t): (r._score, r._code) for r in found} == want and len(found) == len(want)
    assert S.closest_names(left.limit(0), right, {"s": "scope", "y": "year"}, "t", "n", "c").count() == 0
    assert S.closest_names(left, right.limit(0), {"s": "scope", "y": "year"}, "t", "n", "c").count() == 0


def test_few_names_are_compared_in_full():
    draw = random.Random(4)
    names = list({"".join(draw.choices("安徽州南北东西山河湖海江岭平川林木石田水火金土城关口门桥", k=draw.randint(2, 5))) for _ in range(3000)})
    index = S.LetterIndex(names, [f"{i:05}" for i in range(len(names))])
    compared = 0
    for name in draw.sample(names, 100):
        target = misspelt(draw, name) or name
        score, code, many = index.closest(target)
        assert (score, code) == plain(target, list(zip(names, index.codes)))
        compared += many
    assert compared < 100 * len(names) / 50


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_pairs_compared_grow_with_the_targets(spark, scale, monkeypatch):
    """Names compared per target stay few at both scales."""
    kept = []
    monkeypatch.setattr(K, "closest_names", lambda *a, f=K.closest_names: kept.append(f(*a)) or kept[-1])
    rows, crosswalk = KQ.match_inputs(spark, f"/root/testdata/{scale}")
    K.crosswalk_match(rows, crosswalk)
    many, pairs = kept[0].agg(F.count(F.lit(1)), F.sum("_compared")).first()
    assert many and pairs <= 25 * many
