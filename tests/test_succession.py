"""Succession by pointer doubling against the plain recursion."""

import random

import pytest

from fieldframe.operators import succession as S
from fieldframe.operators.crosswalk import is_active

SHAPE = "code string, start_year int, end_year int, new_codes array<string>"


def recursion(code, records, seen=()):
    """Codes that a walk from ``code`` ends at, in the order of a depth-first walk that stops where it meets its own way."""
    if code in seen:
        return [code]
    found = records.get(code, [])
    if any(s <= 2022 and (e is None or 2022 < e) for s, e, _ in found):
        return [code]
    ahead = next((n for _, _, n in sorted(found, key=lambda r: -r[0]) if n), [])
    out = [end for n in ahead for end in recursion(n, records, (*seen, code))] or [code]
    return list(dict.fromkeys(out))


def resolved(spark, rows):
    df = spark.createDataFrame(rows, SHAPE)
    return {r["code"]: r["standard_codes"] for r in S.joined_codes(S.resolve(df, is_active(2022))).collect()}


def compare(spark, rows):
    records = {}
    for code, *rest in rows:
        records.setdefault(code, []).append(rest)
    assert resolved(spark, rows) == {c: recursion(c, records) for c in records}


def old(code, *ahead):
    return (code, 1980, 1990, list(ahead))


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(S, "_doubled", lambda jumps, f=S._doubled: rounds.append(1) or f(jumps))
    found = resolved(spark, [old(f"c{i}", f"c{i + 1}") for i in range(2000)] + [("c2000", 1980, None, [])])
    assert len(found) == 2001 and set(map(tuple, found.values())) == {("c2000",)} and len(rounds) < 15


def test_long_cycle_with_a_tail_and_an_exit(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(S, "_doubled", lambda jumps, f=S._doubled: rounds.append(1) or f(jumps))
    rows = [old(f"k{i}", f"k{(i + 1) % 50}") for i in range(49)] + [old("k49", "k0", "out")]
    rows += [old(f"t{i}", f"t{i + 1}") for i in range(60)] + [old("t60", "k7"), ("out", 1980, None, [])]
    found = resolved(spark, rows)
    assert found["t0"] == ["k7", "out"] and found["k3"] == ["k3", "out"] and found["out"] == ["out"]
    assert len(rounds) < 16


def test_forks_cycles_and_ladders(spark):
    ladder = [old(f"{s}{i}", f"a{i + 1}", f"b{i + 1}") for i in range(8) for s in "ab"] + [("a8", 1980, None, []), ("b8", 1980, None, [])]
    knots = [old("1", "2"), old("2", "1"), old("3", "3"), old("4", "x", "2", "4", "3"), old("5", "4", "1"), old("6", "7", "8"), old("7", "8", "a0"), old("8", "6", "9"), old("9", "1", "6")]
    odd = [("m", 1980, 1985, ["a8"]), ("m", 1990, 1995, ["b8", "gone", "b8"]), ("m", 2000, 2001, []), ("future", 2030, None, []), old("none")]
    compare(spark, ladder + knots + odd)


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs_equal_the_recursion(spark, seed):
    draw = random.Random(seed)
    names = [f"n{i}" for i in range(24)]
    rows = []
    for n in names:
        if draw.random() < 0.15:
            rows.append((n, 1980, None, draw.sample(names, 1)))
        else:
            rows.append(old(n, *draw.sample(names, draw.choice([0, 1, 1, 1, 2]))))
    compare(spark, rows)


def test_empty_and_null(spark):
    assert resolved(spark, []) == {}
    df = spark.createDataFrame([("a", 1980, 1990, [None, "b"]), ("b", None, None, None), ("c", 1980, 1990, [None])], SHAPE)
    found = {r["code"]: r["standard_codes"] for r in S.joined_codes(S.resolve(df, is_active(2022))).collect()}
    assert found == {"a": ["b"], "b": ["b"], "c": ["c"]}
