from __future__ import annotations

import gzip
import hashlib
import io

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, IsNull, Not, StringStartsWith

import __spark_entry__ as entry_points
from tests.compare import differences, duck
from wardstat.llm import warc

SF = "/root/testdata/sf0.001"


def test_matches_sql(spark):
    key = "op11_warc"
    assert differences(entry_points.queries()[key](spark, SF), duck(SF), entry_points.oracle_sql()[key]) is None


ROWS = [
    (5, "http://a/1", "x" * 100), (3, "http://a/2", "x" * 100), (3, "http://a/2", "x" * 100), (9, None, "x" * 100), (None, "u", "x" * 100),
    (1, "http://a/3", "y" * 99), (2, "http://a/4", "y" * 99), (4, "line\r\nWARC-Type: fake", "WARC/1.1\r\nWARC-Type: fake\r\n\r\n" * 9),
    (6, "http://a/5", None), (7, "http://a/6", ""), (8, "http://ü", "漢字 😀\r\n\r\n" * 60), (10, "http://a/7", "long " * 400_000),
    (None, "u", "only without id" * 9), (None, "u", "only without id" * 9),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(i, u, h, "k", "d") for i, u, h in rows], "page_id long, url string, html string, key string, digest string").repartition(4)


def expected(rows):
    out = []
    for ident, _, html in rows:
        data = (html or "").encode()
        ids = [i for i, _, h in rows if i is not None and (h or "") == (html or "")]
        first = min(ids) if ids and len(data) >= 100 else None
        revisit = first is not None and ident != first
        digest = hashlib.sha256(data).hexdigest()
        out.append((ident, len(data), digest, "revisit" if revisit else "response", first if revisit else None, digest))
    return sorted(out, key=repr)


def test_edge_rows(spark):
    got = warc.archived(pages(spark))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(ROWS)
    assert warc.archived(pages(spark, [])).count() == 0


def test_heavy_and_light_copies(spark):
    rows = [(k, "u", f"payload {k % 7 if k < 3000 else k % 1500} " + "z" * 100) for k in range(5000)]
    got = warc.archived(pages(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows)


def test_string_ids(spark):
    rows = [("b%41 ?", "u", "x" * 200), ("a\n+&", "u", "x" * 200), ("?", "u", "short"), (None, "u", "none")]
    table = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.archived(table).collect()}
    assert got == {("b%41 ?", "revisit", "a\n+&"), ("a\n+&", "response", None), ("?", "response", None), (None, "response", None)}


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "a")
    rows = [(k, f"http://h{k % 3}/{k}", f"<p>page {k // 2}</p>" * 40) for k in range(300)]
    warc.archive_pages(pages(spark, rows), path, file_bytes=20_000)
    return path


def test_files_roll_and_gunzip_reads_them(spark, archive):
    files = warc.archive_files(archive)
    assert len(files) > 2 and all(size < 22_000 for _, size in files)
    text = b"".join(gzip.open(name).read() for name, _ in files)
    assert text.count(b"WARC/1.1\r\n") == 300 and text.count(b"WARC-Type: revisit") == 150


def test_predicates_are_pushed_and_blocks_skipped(spark, archive):
    query = warc.read_warc(spark, archive, "record_id string, record_type string, payload binary").where(
        (F.col("record_type") == "revisit") & F.col("record_id").isin("urn:page:1", "urn:page:2", "urn:page:3") & (F.length("payload") >= 0)
    )
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "record_type#" not in plan.split("Filter ")[1].split("\n")[0] and "In(record_id" not in plan.split("Filter ")[1].split("\n")[0]
    assert sorted(r.record_id for r in query.collect()) == ["urn:page:1", "urn:page:3"]
    # Without the block columns no record is inflated beyond its header.
    for name, _ in warc.archive_files(archive):
        with pa.OSFile(name) as file:
            stream = warc._Gzip(warc._Cursor(file))
            for _ in warc.records(stream, lambda row: False):
                raise AssertionError
            assert not stream.out
    small = warc.read_warc(spark, archive, "record_id string", partition_bytes=1)
    assert small.rdd.getNumPartitions() == len(warc.archive_files(archive)) and small.count() == 300


def test_files_of_failed_tasks_do_not_count(spark, archive):
    with open(f"{archive}/part-99999-left.warc.gz", "wb") as out:
        out.write(warc.gzip_member(warc.warc_record({"record_id": "urn:page:999"}, "d")))
    assert warc.read_warc(spark, archive, "record_id string").count() == 300


def test_append_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "w")
    rows = spark.createDataFrame([("urn:x:1", b"one")], "record_id string, payload binary")
    warc.write_warc(rows, path)
    warc.write_warc(rows, path)
    assert warc.read_warc(spark, path).count() == 2
    warc.write_warc(rows, path, mode="overwrite")
    got = warc.read_warc(spark, path).collect()
    assert [(r.record_id, r.payload, r.payload_length, r.refers_to) for r in got] == [("urn:x:1", b"one", 3, None)]


RECORDS = [{"record_id": f"urn:x:{k}", "payload": bytes([k % 251]) * (k * 997 % 200_000), "payload_digest": "sha256:0"} for k in range(60)]


@pytest.mark.parametrize("form", ["plain", "members", "one member", "members without lengths"])
def test_foreign_forms(form, tmp_path):
    data = [warc.warc_record(r, "d") for r in RECORDS]
    if form == "plain":
        raw = b"".join(data)
    elif form == "members":
        raw = b"".join(map(warc.gzip_member, data))
    elif form == "one member":
        raw = gzip.compress(b"".join(data))
    else:
        named = io.BytesIO()
        with gzip.GzipFile("name.warc", "wb", fileobj=named) as out:
            out.write(data[0])
        raw = named.getvalue() + b"".join(map(gzip.compress, data[1:]))
    path = tmp_path / "a.warc"
    path.write_bytes(raw)

    def read(**how):
        with pa.OSFile(str(path)) as file:
            cursor = warc._Cursor(file)
            stream = warc._Plain(cursor) if form == "plain" else warc._Gzip(cursor)
            return list(warc.records(stream, **how))

    assert [r["payload"] for r in read()] == [r["payload"] for r in RECORDS]
    some = read(wanted=lambda row: row["record_id"].endswith("7"))
    assert [r["payload"] for r in some] == [r["payload"] for r in RECORDS if r["record_id"].endswith("7")]
    assert [r["record_id"] for r in read(block=False)] == [r["record_id"] for r in RECORDS]


def test_truncated_archives_fail(tmp_path):
    raw = b"".join(warc.gzip_member(warc.warc_record(r, "d")) for r in RECORDS[:5])
    path = tmp_path / "cut.warc.gz"
    path.write_bytes(raw[:-400])
    for block in (True, False):
        with pa.OSFile(str(path)) as file, pytest.raises(ValueError):
            list(warc.records(warc._Gzip(warc._Cursor(file)), block=block))


def test_predicates_follow_sql():
    row = {"record_type": "response", "target_uri": None, "content_length": 7}
    a, u, c = ("record_type",), ("target_uri",), ("content_length",)
    assert warc.passes(EqualTo(a, "response"), row) and not warc.passes(Not(EqualTo(a, "response")), row)
    assert not warc.passes(EqualTo(u, "x"), row) and not warc.passes(Not(EqualTo(u, "x")), row)
    assert warc.passes(IsNull(u), row) and not warc.passes(Not(IsNull(u)), row) and warc.passes(IsNotNull(a), row)
    assert warc.passes(GreaterThan(c, 6), row) and warc.passes(StringStartsWith(a, "re"), row) and warc.passes(In(a, ("x", "response")), row)
    assert not warc.pushable(EqualTo(("payload",), b"")) and not warc.pushable(EqualTo(("headers", "x"), "")) and not warc.pushable(In(a, ("x", None)))
