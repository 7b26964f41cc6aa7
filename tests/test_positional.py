"""Row positions in files, alignment by position, and one file written by many tasks."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from wardstat.sources import positional
from wardstat.sources.csvfiles import read_csv


@pytest.fixture(scope="module")
def numbered_files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    total = 0
    for name, rows in (("b.csv", 700), ("a.csv", 1300), ("c.csv", 0), ("d.csv", 1)):
        with open(folder / name, "w") as out:
            out.write("v,t\n")
            # Lines of uneven length, so that splits hold uneven numbers of rows.
            out.writelines(f"{k},{'x' * (k * 37 % 90)}\n" for k in range(rows))
        total += rows
    return str(folder), total


@pytest.mark.parametrize("split_bytes", [None, 1500, 4096])
def test_numbers_follow_files_and_lines(spark, numbered_files, split_bytes):
    folder, total = numbered_files
    rows = positional.numbered_csv(spark, folder, "v long, t string", split_bytes=split_bytes).orderBy("row_number").collect()
    assert [r.row_number for r in rows] == list(range(total))
    assert [r.v for r in rows] == [*range(1300), *range(700), 0]


def test_splits_are_really_cut(spark, numbered_files):
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    splits = session.read.csv(numbered_files[0], header=True).select("_metadata.file_block_start", "_metadata.file_path").distinct().count()
    assert splits > 20


def test_alignment(spark):
    left = spark.createDataFrame([(k, f"l{k}") for k in range(5)], "row_number long, a string")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(4)], "row_number long, b string")
    with pytest.raises(ValueError, match="5 and 4 rows"):
        positional.align_by_position(left, right)
    loose = positional.align_by_position(left, right, strict=False).orderBy("row_number").collect()
    assert [r.b for r in loose] == ["r0", "r1", "r2", "r3", None]


def table(spark, parts):
    odd = [None, "", "a,b", 'say "hi"', "ü漢😀", "plain"]
    rows = [((k * 7919) % 2003, odd[k % 6], k / 7, k % 5 if k % 3 else None) for k in range(2003)]
    return spark.createDataFrame(rows, "id long, `te,xt` string, x double, n int").repartition(parts)


@pytest.mark.parametrize("index", [None, "", "row"])
def test_one_file_whatever_the_tasks(spark, tmp_path, index):
    contents = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in (1, 32):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            path = str(tmp_path / f"{parts}.csv")
            size = positional.write_csv_file(table(spark, parts), path, ["id"], index)
            positional.write_csv_parts(table(spark, parts), str(tmp_path / f"{parts}.parts"), ["id"], index)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        contents.append(open(path, "rb").read())
        assert len(contents[-1]) == size and not os.path.exists(path + "._partial")
        folder = tmp_path / f"{parts}.parts"
        joined = b"".join((folder / n).read_bytes() for n in sorted(os.listdir(folder)) if n.startswith("part-"))
        assert joined == contents[-1]
    assert contents[0] == contents[1]
    lines = contents[0].decode().splitlines()
    lead = "" if index is None else f"{index},"
    assert lines[0] == lead + 'id,"te,xt",x,n' and len(lines) == 2004
    if index is not None:
        assert [int(line.split(",")[0]) for line in lines[1:]] == list(range(2003))
    schema = ("" if index is None else "i long, ") + "id long, `te,xt` string, x double, n int"
    back = read_csv(spark, str(tmp_path / "1.csv"), schema)
    assert sorted(map(repr, back.select("id", "te,xt", "x", "n").collect())) == sorted(map(repr, table(spark, 1).collect()))


def test_empty_file(spark, tmp_path):
    empty = table(spark, 1).where(F.lit(False))
    path = str(tmp_path / "e.csv")
    assert positional.write_csv_file(empty, path, ["id"]) == len('id,"te,xt",x,n\n')
    assert open(path).read() == 'id,"te,xt",x,n\n'
    with pytest.raises(ValueError, match="shared file system"):
        positional.write_csv_file(empty, "hdfs://x/y.csv", ["id"])
