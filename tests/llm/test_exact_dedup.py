from __future__ import annotations

import hashlib
from collections import defaultdict

import __spark_entry__ as entry_points
from tests.compare import differences, duck
from tests.llm import edge
from wardstat.llm import exact_dedup

SF = "/root/testdata/sf0.001"


def test_matches_sql(spark):
    key = "op5_exact_dedup"
    assert differences(entry_points.queries()[key](spark, SF), duck(SF), entry_points.oracle_sql()[key]) is None


def test_edge_rows(spark):
    found = exact_dedup.exact_dedup_rows(edge.table(spark)).select("row.doc_id", "row.text", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert len(found) == len(edge.ROWS)
    groups = defaultdict(list)
    for r in found:
        groups[exact_dedup.normalised(r.text)].append(r)
    for content, rows in groups.items():
        best = min((-len(r.text or ""), r.doc_id is None, r.doc_id or 0) for r in rows)
        assert [r.kept for r in rows].count(True) == 1
        assert {(r.keep_id, r.group_size) for r in rows} == {(None if best[1] else best[2], len(rows))}
        assert {r.text_sha256 for r in rows} == {hashlib.sha256(content).hexdigest()}
    kept = exact_dedup.keep_distinct(edge.table(spark))
    assert kept.columns == edge.table(spark).columns and kept.count() == len(groups)
    assert exact_dedup.keep_distinct(edge.empty(spark)).count() == 0


def test_grace_spills_and_finds_the_same_groups():
    texts = [f"text {k % 700} {'x' * (k % 13)}" for k in range(5000)] + ["hot"] * 3000

    def records():
        for k, t in enumerate(texts):
            c = exact_dedup.normalised(t)
            yield hashlib.sha256(c).digest(), c, [(0, k)], (-len(t), False, k, 0, k), 1

    whole = list(exact_dedup.grace(records(), 1 << 30, 4))
    small = list(exact_dedup.grace(records(), 4000, 4))
    as_set = lambda groups: {(tuple(sorted(m)), b, n) for m, b, n in groups}
    assert as_set(whole) == as_set(small)


def test_table_compares_contents_not_digests():
    table = exact_dedup.ContentTable()
    same = b"\0" * 32
    entries = [table.find(same, str(k % 2000).encode()) for k in range(4000)]
    assert entries == [k % 2000 for k in range(4000)]
