"""Encodings of groups of files, and the ordered sink."""

import glob

import pytest
from pyspark.sql import functions as F

from fieldframe.sources import tables as TB


@pytest.fixture
def group(tmp_path):
    text = "年份,省份,备注\n" + "".join(f"{2000 + i},河北,第{i}行\n" for i in range(200))
    made = {"marked.csv": text.encode("utf-8-sig"), "plain.csv": text.encode(), "old.csv": text.encode("gb18030"),
            "west.csv": "年份".encode() + b",caf\xe9 \xff\n2001,\xa0\xff\n", "ascii.csv": b"a,b\n1,2\n", "empty.csv": b""}
    lines = text.encode().split(b"\n")
    lines[150] = b"2150,\xff\xff,x"  # one damaged line far from the start
    made["damaged.csv"] = b"\n".join(lines)
    for name, raw in made.items():
        (tmp_path / name).write_bytes(raw)
    return tmp_path


def test_one_vote_per_file(spark, group):
    found = {r.path.split("/")[-1]: r.encoding for r in TB.file_encodings(spark, f"{group}/*.csv").collect()}
    assert found == {"marked.csv": "UTF-8", "plain.csv": "UTF-8", "old.csv": "GB18030", "west.csv": "ISO-8859-1",
                     "ascii.csv": "UTF-8", "damaged.csv": "ISO-8859-1"}


def test_files_of_several_encodings_are_read_together(spark, group):
    for name in ("west.csv", "ascii.csv", "damaged.csv", "empty.csv"):
        (group / name).rename(group / f"{name}.txt")
    df = TB.read_csv_any(spark, f"{group}/*.csv")
    rows = {(r["年份"], r["省份"], r["备注"]) for r in df.collect()}
    assert df.columns == ["年份", "省份", "备注"] and df.count() == 600
    assert rows == {(str(2000 + i), "河北", f"第{i}行") for i in range(200)}
    alone = TB.read_csv_any(spark, f"{group}/damaged.csv.txt")
    assert alone.count() == 200 and alone.where(F.col(alone.columns[1]).contains("ÿÿ")).count() == 1


def files(path):
    return {p.split("/")[-2]: p for p in sorted(glob.glob(f"{path}/file=*/part-*"))}


@pytest.mark.parametrize("form", ["parquet", "csv"])
def test_ordered_files_do_not_depend_on_the_input_split(spark, tmp_path, form):
    rows = [(i * 7919 % 500 // 3, None if i % 11 == 0 else f"n{i % 5}", float(i % 4), i % 2 == 0) for i in range(1000)]
    df = spark.createDataFrame(rows + rows[:50], "k int, s string, v double, b boolean")
    seen = []
    for parts, run in ((1, "a"), (13, "b")):
        path = f"{tmp_path}/{run}"
        manifest = TB.write_ordered(df.repartition(parts), path, ["k", "s"], rows_per_file=300, form=form)
        found = files(path)
        assert [tuple(r) for r in manifest.orderBy("file").collect()] == [(f"{i:05}", 300 if i < 3 else 150) for i in range(4)]
        assert list(found) == [f"file={i:05}" for i in range(4)]
        if form == "csv":
            seen.append([open(p).read() for p in found.values()])
        else:
            import pyarrow.parquet as pq

            seen.append([pq.ParquetFile(p).read().to_pylist() for p in found.values()])
            key = lambda r: tuple((v is not None, v) for v in (r["k"], r["s"], r["v"], r["b"]))
            flat = [r for part in seen[-1] for r in part]
            assert flat == sorted(flat, key=key) and len(flat) == 1050
    assert seen[0] == seen[1]


def test_ordered_sink_of_an_empty_table_and_maps(spark, tmp_path):
    empty = spark.createDataFrame([], "k int, m map<string,int>")
    assert TB.write_ordered(empty, f"{tmp_path}/none", ["k"]).count() == 0 and not files(f"{tmp_path}/none")
    maps = spark.createDataFrame([(1, {"b": 2}), (1, {"a": 1}), (None, None)], empty.schema)
    TB.write_ordered(maps, f"{tmp_path}/maps", [F.col("k").desc_nulls_last()], rows_per_file=2)
    assert [r.k for r in spark.read.parquet(f"{tmp_path}/maps/file=00000").collect()] == [1, 1]
