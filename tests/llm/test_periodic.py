from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry_points
from tests.llm import edge
from wardstat.llm import periodic

SF = "/root/testdata/sf0.001"


def brute_runs(words):
    """All maximal repetitions by trying every lag at every place."""
    found = []
    for q in range(1, len(words) // 4 + 1):
        same = [words[k] == words[k + q] for k in range(len(words) - q)] + [False]
        start = None
        for k, s in enumerate(same):
            if s and start is None:
                start = k
            if not s and start is not None:
                stretch = words[start : k + q]
                if len(stretch) >= max(6, 4 * q) and all(stretch[r:] != stretch[:-r] for r in range(1, q)):
                    found.append((start, len(stretch), q))
                start = None
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    """The digest columns by the letter of the contract."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id,
        len(runs),
        *(best or (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in rows if len((r.text or "").split()) < 1500]
    wanted = {r.doc_id: expected(r.doc_id, r.text) for r in short}
    found = {r.doc_id: tuple(r) for r in entry_points.queries()["op12_periodic_runs"](spark, SF).collect()}
    assert len(found) == len(rows) and len(short) > 150
    assert {k: found[k] for k in wanted} == wanted
    assert sum(v[1] > 0 for v in wanted.values()) > 10


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 8)), max_size=6))
def test_runs_of_random_repetitions(parts):
    words = [b"%d" % w for base, times in parts for w in base * times]
    assert [tuple(r) for r in periodic.find_runs(words).tolist()] == brute_runs(words)


def test_splitting_recurses():
    # Without "x" the middle holds three "b" only, which then splits its own segment.
    words = b"a a a b a a x a b a b a x y z".split()
    places, _ = periodic.surviving_segments(periodic.word_numbers(words), shortest=2)
    assert all(words[p] == b"a" for p in places)


def test_long_texts_take_seconds():
    rng = random.Random(3)
    noise = [b"%d" % rng.randrange(50) for _ in range(200_000)]
    period = [b"p%d" % k for k in range(30_000)]
    runs = periodic.find_runs(noise + period * 5 + [b"end"])
    assert (200_000, 150_000, 30_000) in [tuple(r) for r in runs.tolist()]


def test_collapse_and_ties():
    words = b"a a a a a a b c b c b c b c d d d d d d".split()
    runs = periodic.find_runs(words)
    assert runs.tolist() == [[0, 6, 1], [6, 8, 2], [14, 6, 1]]
    assert periodic.best_run(runs) == (0, 6, 1)
    assert periodic.collapsed_words(words, runs) == b"a b c d"


@pytest.mark.parametrize("query", [False, True])
def test_edge_rows(spark, query):
    table = edge.table(spark)
    if query:
        found = periodic.report(periodic.periodic_runs(periodic.with_planted_periods(table.select("doc_id", "text"))))
        short = [r for r in edge.ROWS if len((r[1] or "").split()) < 1500]
        got = sorted((tuple(r) for r in found.collect()), key=repr)
        wanted = [expected(*r) for r in short]
        assert len(got) == len(edge.ROWS) and all(w in got for w in wanted)
        return
    found = periodic.periodic_runs(table)
    assert found.select("row.*").columns == table.columns
    rows = found.collect()
    assert len(rows) == len(edge.ROWS)
    for r in rows:
        words = (r.row.text or "").encode().split()
        assert r.n_words == len(words) and (r.best is None) == (not r.runs)
        if r.row.doc_id == 10:
            assert [tuple(x) for x in r.runs] == [(0, 30_000, 1)] and r.collapsed == "tail"
        if r.row.text is None:
            assert (r.n_words, r.runs, r.best, r.collapsed) == (0, [], None, "")
    assert periodic.periodic_runs(edge.empty(spark)).count() == 0
