from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import edge
from wardstat.llm import decontamination, order_minhash


def sequence(text):
    return next(iter(order_minhash.shingles(pa.array([text], pa.string()))))[2]


def common_in_order(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = (last + 1 if x == y else max(row[j], row[j + 1])), row[j + 1]
    return row[-1]


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 30, rng.integers(1, 60)).astype(np.uint64)
        b = np.delete(a, rng.integers(0, len(a), rng.integers(0, 4)))
        b = np.insert(b, rng.integers(0, len(b) + 1, rng.integers(0, 4)), 99)
        m = common_in_order(a.tolist(), b.tolist())
        want = m / (len(a) + len(b) - m)
        got = order_minhash.aligned(a, b, 0.8)
        assert got == pytest.approx(want if want >= 0.8 - 1e-9 else 0.0)


def classes_by_brute_force(texts):
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seqs = [sequence(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            a, b = seqs[i], seqs[j]
            if len(a) and len(b):
                alike = order_minhash.aligned(a, b) > 0
            else:
                alike = (texts[i] or "") == (texts[j] or "") and len(a) == len(b)
            if alike:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(texts))]


def planted():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(40, 160))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy) + "." * rng.randint(0, 1))
    # A common passage in otherwise different texts links none of them.
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(60)) for _ in range(40)]
    return texts


@pytest.mark.parametrize("piece", [2, 512])
def test_classes_equal_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(order_minhash, "PIECE", piece)
    texts = planted()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: r for r in order_minhash.near_duplicates(df).select("row.doc_id", "class_id", "class_size", "kept").collect()}
    want = classes_by_brute_force(texts)
    assert [found[k].class_id for k in range(len(texts))] == want
    assert all(found[k].kept == (want[k] == k) and found[k].class_size == want.count(want[k]) for k in range(len(texts)))


def test_near_edge_rows(spark):
    rows = order_minhash.near_duplicates(edge.table(spark)).select("row.doc_id", "row.text", "class_id", "class_size", "kept").collect()
    assert len(rows) == len(edge.ROWS)
    by_id = {r.doc_id: r for r in rows if r.doc_id in (1, 3, 4, 5, 6, 7, 8)}
    assert by_id[3].class_id == 1 and by_id[1].class_size == 4
    assert by_id[4].class_id == by_id[5].class_id == 4 and by_id[4].class_size == 3
    assert [by_id[k].class_id for k in (6, 7, 8)] == [6, 7, 8]
    kept = order_minhash.keep_one(edge.table(spark))
    assert kept.columns == edge.table(spark).columns
    assert kept.count() == len({(r.class_id, r.class_id in (None, 12) and r.text) for r in rows})
    assert order_minhash.near_duplicates(edge.empty(spark)).count() == 0


def test_recall_on_the_test_documents(spark):
    """All pairs of the small test table that reach the similarity, found by counting common shingles."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    label = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(rows).select("row.doc_id", "class_id").collect()}
    held = defaultdict(list)
    sequences = {}
    for r in rows.collect():
        own = sequence(r.text)
        sequences[r.doc_id] = own
        for h in np.unique(own).tolist():
            held[h].append(r.doc_id)
    counts = defaultdict(int)
    for ids in held.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                counts[a, b] += 1
    near = [
        (a, b) for (a, b), n in counts.items()
        if n >= 0.5 * max(len(np.unique(sequences[a])), len(np.unique(sequences[b]))) and order_minhash.aligned(sequences[a], sequences[b])
    ]
    assert len(near) > 100
    assert sum(label[a] == label[b] for a, b in near) >= 0.98 * len(near)


def test_components_of_a_path_and_a_star(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)]
    found = {r.node: r.label for r in order_minhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}}


ITEMS = ["one two three four five six seven eight nine ten eleven twelve", "alpha beta gamma", "", None, " ".join(f"q{k}" for k in range(50))]


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    docs = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(rng.randint(0, 120))) for _ in range(60)]
    for k in range(0, 60, 3):
        item = ITEMS[rng.choice([0, 1, 4])].split()
        if k % 2 and len(item) > 20:
            item[rng.randrange(4)] = "changed"
        docs[k] = f"{docs[k]} {' '.join(item).upper()}, {docs[(k + 1) % 60]}"
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    found = {(r.doc_id, leak.item_id) for r in decontamination.find_leaks(df, items).select("row.doc_id", "leaks").collect() for leak in r.leaks}
    known = [(k, sequence(t)) for k, t in enumerate(ITEMS) if len(sequence(t))]
    index = decontamination.ItemIndex([k for k, _ in known], [s for _, s in known])
    want = set()
    for d, text in enumerate(docs):
        words = sequence(text)
        for k, (item, own) in enumerate(known):
            size = min(len(own), len(words))
            if any(index.similarity(words[s : s + size], k) >= 0.8 for s in range(len(words) - size + 1) if size):
                want.add((d, item))
    assert found == want and len(want) >= 10


def test_pass_size_changes_nothing(spark, monkeypatch):
    """2,500 items, many of which share shingles, searched in passes of 10 to 5,000."""
    rng = random.Random(6)
    phrases = [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(9)) for _ in range(40)]
    texts = [" ".join([phrases[rng.randrange(40)], *(f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(4, 12))), phrases[rng.randrange(40)]]) for _ in range(2500)]
    docs = []
    for k in range(60):
        words = texts[k * 37].split()
        for _ in range(k % 4):
            words[rng.randrange(len(words))] = "other"
        docs.append((f"doc{k}", " ".join([*(f"v{j}" for j in range(k)), *words, "tail"])))
    df = spark.createDataFrame(docs, "doc_id string, text string").repartition(2)
    items = spark.createDataFrame([(f"item{k}", t) for k, t in enumerate(texts)], "item_id string, text string")
    results = []
    for size in (10, 1000, 5000):
        monkeypatch.setattr(decontamination, "ITEMS_PER_PASS", size)
        few = items.limit(60) if size == 10 else items  # six passes of ten say enough about small ones
        found = decontamination.find_leaks(df, few).select("row.doc_id", "leaks").collect()
        results.append({(r.doc_id, leak.item_id, round(leak.similarity, 9), leak.start) for r in found for leak in r.leaks})
        if size == 10:
            monkeypatch.setattr(decontamination, "ITEMS_PER_PASS", 5000)
            whole = decontamination.find_leaks(df, few).select("row.doc_id", "leaks").collect()
            assert results.pop() == {(r.doc_id, leak.item_id, round(leak.similarity, 9), leak.start) for r in whole for leak in r.leaks}
    assert results[0] == results[1] and len(results[0]) > 10 and any(v < 1 for _, _, v, _ in results[0])


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    index = decontamination.ItemIndex(list(range(50)), [rng.integers(1, 1 << 60, 9).astype(np.uint64) for _ in range(50)])
    prints = []
    for value in index.prints:
        for flips in (0, 5, 18, 19, 20, 25):
            mask = sum(1 << int(b) for b in rng.choice(64, flips, replace=False))
            prints.append(int(value) ^ mask)
    prints = np.array(prints, np.uint64)
    want = {(k, i) for k, p in enumerate(prints) for i, v in enumerate(index.prints) if int(p ^ v).bit_count() <= decontamination.RADIUS}
    assert set(index.within(prints)) == want


def test_leak_edge_rows(spark):
    items = spark.createDataFrame([(1, edge.PROSE), (2, "")], "item_id long, text string")
    clean = decontamination.keep_clean(edge.table(spark), items)
    assert clean.columns == edge.table(spark).columns
    assert clean.count() == len(edge.ROWS) - 5
    assert decontamination.keep_clean(edge.table(spark), items.limit(0)).count() == len(edge.ROWS)
    assert decontamination.find_leaks(edge.empty(spark), items).count() == 0
