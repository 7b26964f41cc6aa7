from __future__ import annotations

import random

import numpy as np

from tests.llm import edge
from wardstat.llm import suffix_dedup


def brute_force(rows):
    first = {}
    rank = lambda i: suffix_dedup.NO_ID if i is None else i
    for i, text in rows:
        body = (text or "").encode()
        for s in range(len(body) - 49):
            w = body[s : s + 50]
            first[w] = min(first.get(w, rank(i)), rank(i))
    out = []
    for i, text in rows:
        body = (text or "").encode()
        gone = bytearray(len(body))
        for s in range(len(body) - 49):
            if first[body[s : s + 50]] < rank(i):
                gone[s : s + 50] = b"\1" * 50
        out.append((i, len(body), sum(gone), bytes(c for c, g in zip(body, gone) if not g)))
    return out


def check(spark, rows):
    df = edge.table(spark, rows)
    found = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(found, key=key) == sorted(brute_force(rows), key=key)


def test_edge_rows_equal_brute_force(spark):
    check(spark, edge.ROWS)
    assert suffix_dedup.report(suffix_dedup.remove_repeats(edge.empty(spark))).count() == 0


def test_planted_passages_equal_brute_force(spark):
    rng = random.Random(8)
    letters = "ab "  # few letters make many accidental repeats of anchors
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(45, 130))) for _ in range(12)]
    rows = []
    for k in range(120):
        text = "".join(rng.choice("abcdefgé ") for _ in range(rng.randint(0, 200)))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            text += p[rng.randint(0, 5) :] + rng.choice("xyz")
        rows.append((k, text + "ab" * rng.randint(0, 60)))
    check(spark, rows)


def test_ids_that_are_text(spark):
    rng = random.Random(9)
    passages = ["".join(rng.choice("abc ") for _ in range(90)) for _ in range(5)]
    rows = [(k, rng.choice(passages)[rng.randint(0, 9) :] + str(k) + rng.choice(passages)) for k in range(40)] + [(None, passages[0]), (7, passages[1])]
    named = {k: f"{k:03d}" for k in range(40)} | {None: None}
    df = spark.createDataFrame([(named[i], t, "x") for i, t in rows], "doc_id string, text string, id string").repartition(3)
    found = [(r.doc_id, r.n_bytes, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).collect()]
    want = [(named[i], n, kept) for i, n, _, kept in brute_force(rows)]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_blind_trie_orders_and_groups():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(6)) for _ in range(300)]
    trie = suffix_dedup.BlindTrie()
    for k, t in enumerate(texts):
        trie.insert(t, k)
    leaves = list(trie.leaves())
    assert [texts[m[0]] for m in leaves] == sorted(set(texts))
    assert all(len({texts[k] for k in m}) == 1 for m in leaves) and sum(map(len, leaves)) == 300


def test_multikey_quicksort_within_groups():
    rng = np.random.default_rng(12)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    places = rng.integers(0, 2900, 900)
    body = text.tobytes()
    for shallow in (8, 24):
        for groups in (np.zeros(900, int), rng.integers(0, 40, 900), np.arange(900)):
            order = np.argsort(groups, kind="stable")
            first = np.r_[True, np.diff(groups[order]) != 0]
            first = suffix_dedup.multikey_quicksort(text, places, order, first, shallow)
            keys = [(int(groups[k]), body[places[k] : places[k] + shallow]) for k in order]
            assert keys == sorted(keys) and sorted(order.tolist()) == list(range(900))
            assert first.tolist() == [True, *(a != b for a, b in zip(keys, keys[1:]))]


def test_window_sort_equals_plain_sort():
    rng = np.random.default_rng(3)
    text = np.concatenate([np.frombuffer(b"abcab" * 80, np.uint8), rng.integers(97, 99, 500).astype(np.uint8), np.frombuffer(b"abcab" * 80, np.uint8)])
    places = np.arange(len(text) - 49)
    order, group = suffix_dedup.sort_windows(text, places)
    body = text.tobytes()
    windows = [body[p : p + 50] for p in places[order]]
    assert windows == sorted(windows)
    assert all((a == b) == (g == h) for a, b, g, h in zip(windows, windows[1:], group, group[1:]))


def test_tries_that_grow_together_equal_single_ones(monkeypatch):
    rng = np.random.default_rng(31)
    base = rng.integers(97, 99, (150, 50))
    windows = base[rng.integers(0, 150, 2500)].astype(np.uint8)
    # Half of the copies differ, all behind the bytes that the quicksort looks at, in high bytes as well.
    some = rng.permutation(2500)[:1250]
    windows[some, rng.integers(24, 50, 1250)] = rng.integers(0, 256, 1250)
    text, places = windows.ravel(), np.arange(2500) * 50
    grown = []
    plain = suffix_dedup.blind_tries
    monkeypatch.setattr(suffix_dedup, "blind_tries", lambda texts, starts, sizes: grown.append(len(sizes)) or plain(texts, starts, sizes))
    order, group = suffix_dedup.sort_windows(text, places)
    assert grown and grown[0] >= suffix_dedup.TOGETHER
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 10**9)
    alone, classes = suffix_dedup.sort_windows(text, places)
    assert order.tolist() == alone.tolist() and group.tolist() == classes.tolist() and len(grown) == 1
    keys = [windows[k].tobytes() for k in order]
    assert keys == sorted(keys) and all((a == b) == (g == h) for a, b, g, h in zip(keys, keys[1:], group, group[1:]))


def test_stretches_do_not_depend_on_the_step(monkeypatch):
    rng = np.random.default_rng(32)
    data = np.concatenate([rng.integers(97, 99, 4000), np.full(600, 97), rng.integers(97, 123, 4000)]).astype(np.uint8)
    offsets = np.r_[0, np.sort(rng.integers(0, len(data), 90)), len(data)]
    whole = suffix_dedup.stretches(data, offsets)
    for step in (1, 37, 1000):
        monkeypatch.setattr(suffix_dedup, "STEP_WINDOWS", step)
        assert all(np.array_equal(a, b) for a, b in zip(whole, suffix_dedup.stretches(data, offsets)))
    # Every window of a row is in one stretch, led by the leftmost of the smallest hashes of its strings.
    keys, anchor, first, last, rows = whole
    inside = [w for a, b in zip(offsets, offsets[1:]) for w in range(a, b - suffix_dedup.LENGTH + 1)]
    assert [w for a, b in zip(first, last) for w in range(a, b + 1)] == inside
    with np.errstate(over="ignore"):
        hashes, _ = suffix_dedup._leads(data)
    span = suffix_dedup.LENGTH - suffix_dedup.KMER + 1
    assert all(a == w + hashes[w : w + span].argmin() for a, f, t in zip(anchor, first, last) for w in (f, t))
