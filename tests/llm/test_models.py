from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import edge
from wardstat.llm import hidden_markov, quality, toxicity
from wardstat.llm.queries import QUERIES, remainder

SF = "/root/testdata/sf0.01"


def held_out_accuracy(spark, key, label):
    found = QUERIES[key](spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    hits = [r.predicted == r[label] for r in found]
    assert all(0.0 <= r.score <= 1.0 for r in found)
    return sum(hits) / len(hits)


def test_quality_on_held_out_rows(spark):
    assert held_out_accuracy(spark, "op3_quality", "quality") >= 0.93


def test_toxicity_on_held_out_rows(spark):
    """Area under the curve, what is caught at the threshold, and what is left alone."""
    sf = "/root/testdata/sf0.1"
    found = QUERIES["op8_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    toxic, clean = ([r.score for r in found if r.toxic == v] for v in (1, 0))
    area = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert area >= 0.97 and all(0.0 <= r.score <= 1.0 for r in found)
    assert sum(s >= 0.3 for s in toxic) >= 0.9 * len(toxic) and sum(s >= 0.3 for s in clean) <= 0.05 * len(clean)


def test_toxicity_reads_every_word(spark):
    """Nearly every text has words in common with the examples, and the search equals a dense cosine."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").where(remainder(4) != 2))
    texts = pa.array([r.text for r in docs.collect()], pa.string())
    vectors = list(model.vocabulary.vectors(texts))
    empty = sum(len(t) == 0 for t, _ in vectors)
    blank = sum(not re.search(r"\w", t.as_py() or "") for t in texts)
    assert empty <= blank + 0.02 * len(vectors)
    by_id = {r.doc_id: v for r, v in zip(docs.collect(), vectors)}
    examples = [by_id[i] for i in model.ids]
    scored = {r.doc_id: r.evidence for r in toxicity.score(docs, model).select("row.doc_id", "evidence").collect()}
    dense = np.zeros((len(examples), len(model.vocabulary)))
    for k, (t, w) in enumerate(examples):
        dense[k, t] = w
    for doc_id in sorted(scored, key=lambda i: i or 0)[::25]:
        terms, weights = by_id[doc_id]
        cosine = dense[:, terms] @ weights
        best = [k for k in np.lexsort((np.arange(len(cosine)), -np.round(cosine, 12))) if cosine[k] > 0][:3]
        assert [e.id for e in scored[doc_id]] == [model.ids[k] for k in best]
        assert np.allclose([e.similarity for e in scored[doc_id]], cosine[best])


def labelled(spark, name):
    rows = [(k, k % 2) for k in range(200)] + [(None, 1), (7, None), (999, 1)]
    return spark.createDataFrame(rows, f"doc_id long, {name} int")


def marked(spark):
    rng = random.Random(2)
    words = [f"word{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(20)) + (" vile nasty" if k % 2 else " fine")) for k in range(200)]
    return edge.table(spark, rows)


def test_toxicity_edge_rows(spark):
    model = toxicity.fit(marked(spark), labelled(spark, "toxic"))
    scored = toxicity.score(edge.table(spark, [*edge.ROWS, (50, "vile nasty things"), (51, "fine things")]), model)
    rows = {r.doc_id: r for r in scored.select("row.doc_id", "score", "evidence").collect() if r.doc_id in (4, 5, 50, 51)}
    assert rows[4].score == rows[5].score and rows[4].evidence == []
    assert rows[50].score > 0.8 > 0.2 > rows[51].score
    assert {e.label for e in rows[50].evidence} == {1}
    assert scored.count() == len(edge.ROWS) + 2
    none = toxicity.fit(marked(spark), labelled(spark, "toxic").limit(0))
    assert {r.score for r in toxicity.score(edge.table(spark), none).collect()} == {0.0}
    assert toxicity.score(edge.empty(spark), model).count() == 0
    assert {r.score for r in toxicity.score(marked(spark), toxicity.fit(edge.empty(spark), labelled(spark, "toxic"))).collect()} == {0.0}


@pytest.mark.parametrize("frequent", [0, 10, 96])
def test_block_max_search_is_exact(monkeypatch, frequent):
    rng = np.random.default_rng(6)
    vectors = []
    for _ in range(400):
        terms = np.sort(rng.choice(80, rng.integers(0, 12), replace=False))
        weights = rng.random(len(terms))
        vectors.append((terms, weights / np.linalg.norm(weights) if len(terms) else weights))
    dense = np.zeros((400, 80))
    for k, (t, w) in enumerate(vectors):
        dense[k, t] = w
    monkeypatch.setattr(toxicity, "DENSE", frequent)
    index = toxicity.BlockMaxIndex(80, vectors, block=16)
    for q in range(100):
        cosine = np.round(dense @ dense[q], 12)
        want = [k for k in np.lexsort((np.arange(400), -cosine)) if cosine[k] > 0 and k != q][:15]
        found, scores = index.nearest(*vectors[q], 15, without=q)
        assert found.tolist() == want
        assert np.allclose(scores, cosine[want])


def test_quality_edge_rows(spark):
    model = quality.fit(marked(spark), labelled(spark, "quality"))
    rows = quality.score(edge.table(spark), model).select("row.doc_id", "score").collect()
    assert len(rows) == len(edge.ROWS)
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[4] == by_id[5] and all(0.0 <= r.score <= 1.0 for r in rows)
    assert quality.score(edge.empty(spark), model).count() == 0
    assert {r.score for r in quality.score(edge.table(spark), quality.fit(marked(spark), labelled(spark, "quality").limit(0))).collect()} == {0.5}


def test_quality_features_of_a_row_do_not_depend_on_its_neighbours():
    texts = ["Ab cd cd", "", "x", "wörter und mehr Wörter", None, "Ab cd cd"]

    def by_row(column):
        out = [[] for _ in column]
        for first, _, kinds in quality.features(column):
            for kind, (buckets, rows) in enumerate(kinds):
                for b, r in zip(buckets.tolist(), rows.tolist()):
                    out[first + r].append((kind, b))
        return [sorted(r) for r in out]

    alone = [by_row(pa.array([t], pa.string()))[0] for t in texts]
    assert by_row(pa.array(texts, pa.string())) == alone


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), "\n"]


@pytest.mark.parametrize("range_tokens", [40, 1_000_000])
def test_base_scores_equal_brute_force(spark, monkeypatch, range_tokens):
    monkeypatch.setattr(hidden_markov, "RANGE_TOKENS", range_tokens)
    rows = edge.ROWS + [(100 + k, f"The tree {k % 7} AND the É{k} end") for k in range(80)]
    df = edge.table(spark, rows)
    learned = [t for i, t in rows if i is not None and i % 3]
    counts = Counter(w for t in learned for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    found = hidden_markov.score(df, F.col("doc_id") % 3 != 0, passes=2).collect()
    want = [(i, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows]
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-7)
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def test_model_without_training_rows_and_empty_table(spark):
    rows = hidden_markov.score(edge.table(spark), F.lit(False), passes=1).collect()
    assert {r.train_tokens for r in rows} == {0} and {r.n_known for r in rows} == {0} and {r.base_score for r in rows} == {0.0}
    assert hidden_markov.score(edge.empty(spark), F.lit(True), passes=1).count() == 0


def all_paths(chain, symbols):
    total = chain.start * chain.emits[:, symbols[0]]
    paths = {(s,): total[s] for s in range(len(total))}
    for x in symbols[1:]:
        paths = {(*p, s): w * chain.moves[p[-1], s] * chain.emits[s, x] for p, w in paths.items() for s in range(len(total))}
    return paths


def test_forward_and_expected_counts_equal_all_paths():
    rng = np.random.default_rng(9)
    unit = lambda a: a / a.sum(axis=-1, keepdims=True)
    chain = hidden_markov.Chain(unit(rng.random(3)), unit(rng.random((3, 3))), unit(rng.random((3, 4))))
    lengths = np.array([3, 1, 5, 4, 1])
    symbols = rng.integers(0, 4, lengths.sum()).astype(np.uint16)
    starts, moves, emitted = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 4))
    logs = []
    for a, n in zip(np.cumsum(lengths) - lengths, lengths):
        own = symbols[a : a + n]
        paths = all_paths(chain, own)
        total = sum(paths.values())
        logs.append(math.log10(total))
        for p, w in paths.items():
            starts[p[0]] += w / total
            for s, x in zip(p, own):
                emitted[s, x] += w / total
            for s, t in zip(p, p[1:]):
                moves[s, t] += w / total
    assert np.allclose(hidden_markov.forward(chain, hidden_markov.Steps.of(symbols, lengths))[0], logs)
    got = hidden_markov.expected_counts(chain, symbols, lengths)
    assert np.allclose(got[0], starts) and np.allclose(got[1], moves) and np.allclose(got[2], emitted) and np.isclose(got[3], sum(logs))


def test_likelihood_of_held_out_text_beats_the_base(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = hidden_markov.score(docs, remainder(5) != 1).where(remainder(5) == 1)
    score, base = found.agg(F.sum("score"), F.sum("base_score")).first()
    assert score > base
