from __future__ import annotations

import hashlib
import re
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import edge
from wardstat.llm import pii, sharding


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits(match):
    return re.sub("[^0-9]", "", match)


PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
]


def plain_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in PLAIN for m in re.finditer(p, text) if ok(m[0])]


HAND = [
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 4111111111111111.", "1.2.3.4.5.6.7.8 256.1.1.1 0010.0.0.255 1.1.1",
    "a@b.c_d@e.f x@y @z.w é@ü.de a.b+c@d-e.f.g", "+1 (555) 010-9999 +12 +123456789012345678 ++49 30 1234567-", "0" * 30_000,
    "a." * 20_000, "1 " * 20_000, "a@" + "b." * 20_000, "😀 a@b.cd 漢 +49 30 1234567 x", "",
]


def test_base_spans_are_those_of_the_plain_patterns(spark):
    alphabet = st.text("aA1290.@+-() %_é\n", max_size=60)
    texts = list(HAND)

    @settings(max_examples=400, deadline=None, derandomize=True, database=None)
    @given(alphabet)
    def gather(text):
        texts.append(text)

    gather()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.report(pii.find_pii(df)).collect():
        want = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id][:80]
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(want)
        assert r.spans.startswith(",".join(want))


@pytest.mark.parametrize("unit", ["10.0.0.1 a@b.cd ", "+49 30 1234567, ", "4111 1111 1111 1111 x ", "😀 1.2.3.4; "])
def test_many_matches_take_seconds(spark, unit):
    """Places stay right over many groups of matches, and the time does not grow with their square."""
    text = unit * 30_000
    begin = time.perf_counter()
    row = pii.report(pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert time.perf_counter() - begin < 60
    want = plain_spans(text)
    assert len(want) >= 30_000 and row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()


def test_checks_and_context_add_spans(spark):
    texts = [
        "My IBAN is GB82 WEST 1234 5698 7654 32.", "GB82 WEST 1234 5698 7654 33 is no account", "social security 123-45-6789", "part 123-45-6789",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: [s.kind for s in r.added] for r in pii.find_pii(df).collect()}
    assert rows == {0: ["iban"], 1: [], 2: ["ssn"], 3: []}


def test_pii_edge_rows(spark):
    assert pii.report(pii.find_pii(edge.table(spark))).count() == len(edge.ROWS)
    assert pii.find_pii(edge.empty(spark)).count() == 0


@pytest.mark.parametrize("draws", [1, 24])
def test_shards_are_even_whatever_the_sample(spark, draws):
    rows = [(k, "hot" if k % 3 else f"text {k} " + "y" * (k * 7919 % 400)) for k in range(3000)] + [(7, "twice")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = sharding.shard(df, draws=draws).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in found) == sorted((i, len(t) + 1, zlib.crc32(t.encode())) for i, t in rows)
    load = [0] * 16
    slots = [[] for _ in range(16)]
    for r in found:
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(load) - min(load) <= 2 * max(r["size"] for r in found)
    assert {r.law for r in found} == {"bytes"} and {r.grown_shard for r in found} == {None}


def test_shards_of_text_ids(spark):
    rows = [(f"k{k}" if k % 5 else None, "hot" if k % 3 else f"text {k}") for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    found = sharding.shard(df).collect()
    assert sorted((r.doc_id or "", r["size"]) for r in found) == sorted((i or "", len(t) + 1) for i, t in rows)
    load = [sum(r["size"] for r in found if r.shard == s) for s in range(16)]
    assert max(load) - min(load) <= 30
    slots = {s: sorted(r.slot for r in found if r.shard == s) for s in range(16)}
    assert all(v == list(range(len(v))) for v in slots.values())


def test_sharding_edge_rows(spark):
    assert sharding.shard(edge.table(spark)).count() == len(edge.ROWS)
    assert sharding.shard(edge.empty(spark)).count() == 0
