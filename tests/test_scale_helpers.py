"""Helpers that split hot groups, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldframe.operators import indices as X
from fieldframe.operators import picks, quantiles


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.75, 0.9, 1.0])
def test_exact_quantile_matches_numpy(spark, q):
    rng = random.Random(3)
    rows = [("hot", rng.choice([rng.gauss(0, 1), 1.0, 2.0])) for _ in range(3000)] + [("small", float(i)) for i in range(7)] + [("one", 4.0), (None, 2.0), (None, 3.0)]
    df = spark.createDataFrame(rows + [("hot", None)], "k string, v double")
    got = {r["k"]: r["q"] for r in quantiles.exact_quantile(df, ["k"], "v", q, "q").collect()}
    for key in ("hot", "small", "one", None):
        assert got[key] == pytest.approx(np.quantile([v for k, v in rows if k == key], q), abs=1e-12)
    whole = quantiles.exact_quantile(df, [], "v", q, "q").first()["q"]
    assert whole == pytest.approx(np.quantile([v for _, v in rows], q), abs=1e-12)


def test_exact_quantile_of_many_rows_in_one_key(spark):
    """Ten million rows of one key; no window over data rows is unpartitioned."""
    v = (F.col("id") * 7919 % 10_000_019).cast("double")
    df = spark.range(10_000_000).select(F.lit("hot").alias("k"), v.alias("v"))
    values = np.arange(10_000_000, dtype=np.int64) * 7919 % 10_000_019
    for q in (0.1, 0.905):
        assert quantiles.exact_quantile(df, ["k"], "v", q, "q").first()["q"] == pytest.approx(np.quantile(values, q), abs=1e-6)
    assert quantiles.exact_quantile(df, [], "v", 0.5, "q").first()["q"] == pytest.approx(np.quantile(values, 0.5), abs=1e-6)


def test_number_rows(spark):
    """Wide gaps between ids do not make more ranges than shuffle partitions."""
    keys = sorted(random.Random(1).sample(range(10**15), 500))
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(7)
    numbered = picks.number_rows(df, "k", "n")
    assert {r["k"]: r["n"] for r in numbered.collect()} == {k: i + 1 for i, k in enumerate(keys)}
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in plan and "Window" in plan


def test_pick_one_limits_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    picked = picks.pick_one(df, ["k"], [F.col("id").desc()])
    assert sorted(r["id"] for r in picked.collect()) == [997, 998, 999]
    assert "WindowGroupLimit" in picked._jdf.queryExecution().executedPlan().toString()


def test_max_duration_over_buckets(spark):
    rng = random.Random(5)
    rows = [(u, i, rng.random() < 0.8) for u in range(6) for i in range(400)] + [(9, i, True) for i in range(50)] + [(10, i, False) for i in range(5)]
    df = spark.createDataFrame(rows, "u int, i int, f boolean")
    got = {r["u"]: r["d"] for r in X.max_duration(df, "u", [F.col("i")], F.col("f"), F.floor(F.col("i") / 7), "d").collect()}
    for u in {r[0] for r in rows}:
        best = run = 0
        for flag in [f for k, _, f in sorted(rows) if k == u]:
            run = run + 1 if flag else 0
            best = max(best, run)
        assert got[u] == best


def test_rolling_cv_matches_history(spark):
    rng = random.Random(2)
    rows = [(u, y, None if rng.random() < 0.3 else rng.uniform(1, 9)) for u in "ab" for y in range(2000, 2020)]
    df = spark.createDataFrame(rows, "u string, year int, v double")
    got = {(r["u"], r["year"]): r["cv"] for r in X.rolling_cv(df, ["u"], "v", 5, "cv").collect()}
    for u in "ab":
        history = []
        for _, y, v in [r for r in rows if r[0] == u]:
            history += [] if v is None else [v]
            want = None if len(history) < 5 else float(np.std(history[-5:], ddof=1) / abs(np.mean(history[-5:])))
            assert got[(u, y)] == (None if want is None else pytest.approx(want))


def test_exact_quantiles_of_columns_and_ranks_at_once(spark, monkeypatch):
    """Per key and over all keys from one written range table; columns without values, null keys."""
    written = []
    monkeypatch.setattr(quantiles, "materialize", lambda df, label, f=quantiles.materialize: written.append(label) or f(df, label))
    rng = random.Random(8)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), rng.choice([rng.gauss(0, 1), 1.0]), rng.randint(0, 5) if rng.random() < 0.9 else None, None) for _ in range(4000)]
    rows += [("only_x", 3.0, None, None), ("none", None, None, None)]
    df = spark.createDataFrame(rows, "k string, x double, y int, z double").repartition(6)
    marks = {"x1": ("x", 0.1), "x9": ("x", 0.905), "y5": ("y", 0.5), "z5": ("z", 0.5), "x0": ("x", 0.0)}
    found = quantiles.exact_quantiles(df, ["k"], marks, whole=True).collect()
    assert written == ["quantile"] and len(found) == 5 and sum(r["_whole"] for r in found) == 1
    for r in found:
        for out, (column, q) in marks.items():
            values = [row["xyz".index(column) + 1] for row in rows if r["_whole"] or row[0] == r["k"]]
            values = [v for v in values if v is not None]
            assert r[out] == (pytest.approx(np.quantile(values, q), abs=1e-12) if values else None)
    single = quantiles.exact_quantiles(df, [], marks).collect()
    assert len(single) == 1 and single[0]["y5"] == next(r["y5"] for r in found if r["_whole"]) and single[0]["z5"] is None
    assert tuple(quantiles.exact_quantiles(df.limit(0), [], marks).first()) == (None,) * 5
    assert quantiles.exact_quantiles(df.limit(0), ["k"], marks, whole=True).count() == 0
