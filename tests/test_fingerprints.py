"""Order-free fingerprints of rows against a plain loop."""

import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from fieldframe.sources import files as S

SHAPE = "i long, s string, b boolean, v double"
ROWS = [(1, "a", True, 0.5), (2, None, None, 1.5), (None, "2", False, None), (1, "a", True, 0.5), (-5, "", None, 2.0), (None, None, None, None)]


def chained(seed, value, kind):
    """One step of Spark's chained 64-bit hash of a cell."""
    if value is None:
        return seed
    raw = {"bool": lambda: int(value).to_bytes(4, "little"), "long": lambda: value.to_bytes(8, "little", signed=True),
           "text": lambda: value.encode(), "double": lambda: __import__("struct").pack("<d", value)}[kind]()
    return xxhash.xxh64(raw, seed=seed).intdigest()


def plain(rows):
    """Digest of rows by a loop over all cells."""
    kinds, both = ("long", "text", "bool", "double"), []
    for row in rows:
        cells = list(zip(row, kinds))
        pair = []
        for word, order in (("first", cells), ("second", cells[::-1])):
            h = chained(42, word, "text")
            for value, kind in order:
                h = chained(chained(h, value is None, "bool"), value, kind)
            pair.append(h - (1 << 64) if h >> 63 else h)
        both.append(pair)
    sums, xors = [sum(p[k] for p in both) for k in (0, 1)], [0, 0]
    for pair in both:
        xors = [x ^ y for x, y in zip(xors, pair)]
    return hashlib.sha256(":".join(map(str, (len(rows), *sums, *xors))).encode()).hexdigest()


def digest(spark, rows, parts=1):
    df = spark.createDataFrame(rows, SHAPE).repartition(parts)
    return S.row_digests(df, F.lit("all"), "g").first()


def test_digest_equals_a_plain_loop_in_any_order(spark):
    for parts in (1, 4):
        found = digest(spark, ROWS, parts)
        assert (found["rows"], found["row_digest"]) == (len(ROWS), plain(ROWS))
    assert digest(spark, ROWS[::-1], 3)["row_digest"] == plain(ROWS)


def test_any_changed_cell_or_row_changes_the_digest(spark):
    seen = {plain(ROWS)}
    for k, row in enumerate(ROWS):
        for c, other in enumerate((77, "zz", None if row[2] is not None else True, 9.25)):
            changed = [*ROWS[:k], (*row[:c], other, *row[c + 1:]), *ROWS[k + 1:]]
            seen.add(digest(spark, changed)["row_digest"])
    seen |= {digest(spark, ROWS[1:])["row_digest"], digest(spark, ROWS + ROWS[:1])["row_digest"], digest(spark, ROWS + ROWS)["row_digest"]}
    assert len(seen) == 1 + 4 * len(ROWS) - 4 + 3  # the two equal rows change to equal tables


def test_nulls_inside_nested_values_count(spark):
    one = lambda value: S.row_digests(spark.createDataFrame([(value,)], "a array<int>"), F.lit(1), "g").first()["row_digest"]
    assert len({one(v) for v in ([1, None], [None, 1], [1], [], None, [None])}) == 6


@pytest.mark.parametrize("largest", [S.WHOLE_FILE, 900])
def test_files_over_the_limit_have_a_row_digest_only(spark, tmp_path, largest):
    small, large = f"{tmp_path}/small.parquet", f"{tmp_path}/large.parquet"
    spark.createDataFrame(ROWS, SHAPE).select("i").limit(1).coalesce(1).write.parquet(small)
    spark.range(5000).select(F.col("id").alias("i"), F.sha2(F.col("id").cast("string"), 256).alias("s")).coalesce(1).write.parquet(large)
    found = {r.path.split("/")[-2]: r for r in S.fingerprints(spark, str(tmp_path), "*.parquet", largest).collect()}
    assert (found["large.parquet"].sha256 is None) == (largest == 900) and found["large.parquet"].length > 900
    for name, r in found.items():
        if r.sha256:
            with open(r.path.removeprefix("file:"), "rb") as f:
                assert hashlib.sha256(f.read()).hexdigest() == r.sha256
    again = spark.read.parquet(large).repartition(7).sortWithinPartitions("s")
    by_file = S.row_digests(spark.read.parquet(large)).collect()
    assert len(by_file) == 1 and by_file[0]["row_digest"] == S.row_digests(again, F.lit(""), "g").first()["row_digest"]
