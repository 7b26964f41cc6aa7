"""The stages of the pipeline on hand-made rows, each against a plain count of what should stay."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import edge
from wardstat.llm import exact_dedup

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, id long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", 0.5, 1) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels and a benchmark of their own."""
    path = str(tmp_path_factory.mktemp("sf"))
    labels = [(k, 1, int(k % 4 == 0)) for k in range(1, 400)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, "this passage of the benchmark has more than nine words in it"), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def prose(k):
    return " ".join(f"w{(k * 31 + j * j * 7 + j) % 5000}" for j in range(60))


def kept_ids(df):
    return sorted((r[0] for r in df.select("doc_id").collect()), key=lambda i: (i is None, i or 0))


def test_stages_keep_the_columns_and_survive_edge_rows(spark, folder):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (edge.ROWS, []):
            docs = table(spark, rows)
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns, name
            left = out.collect()
            assert all((r.doc_id, r.text) in edge.ROWS for r in left) and (rows or not left)
    packed = STAGES["best_fit_packing"](spark, table(spark, edge.ROWS), folder)
    assert {r.doc_id for r in packed.collect()} == {i for i, _ in edge.ROWS}
    assert STAGES["best_fit_packing"](spark, table(spark, []), folder).count() == 0


def test_toxic_documents_go(spark, folder):
    bad = "vile foul nasty"
    rows = [(k, f"{prose(k)} {bad if k % 4 == 0 else ''} {prose(k + 7)} {bad if k % 4 == 0 else 'calm'}") for k in range(1, 400)]
    left = set(kept_ids(STAGES["toxicity"](spark, table(spark, rows), folder)))
    clean = {k for k in range(1, 400) if k % 4}
    assert len(clean & left) >= 0.98 * len(clean) and len(left - clean) <= 0.05 * 100


def test_exact_copies_go(spark, folder):
    rows = [(k, prose(k % 40) + " " * (k % 3)) for k in range(200)] + [(None, prose(3)), (7, prose(7)), (500, None), (501, " \t"), (502, "")]
    left = STAGES["exact_dedup"](spark, table(spark, rows), folder).collect()
    best = {}
    for i, t in rows:
        key = exact_dedup.normalised(t)
        best[key] = min(best.get(key, (1, True, 0)), (-len(t or ""), i is None, i or 0))
    assert sorted(r.doc_id for r in left) == sorted(b[2] for b in best.values())


def test_one_of_each_near_group_stays(spark, folder):
    rows = [(k, prose(k)) for k in range(30)]
    for k in range(30):
        words = prose(k).split()
        rows += [(100 * (c + 1) + k, " ".join([*words[: 20 + c], f"new{c}", *words[21 + c :]])) for c in range(k % 4)]
    left = kept_ids(STAGES["near_dedup"](spark, table(spark, rows), folder))
    assert len(left) == 30 and sorted(i % 100 for i in left) == list(range(30))


def test_leaking_documents_go(spark, folder):
    passage = "This passage of the benchmark has more than nine words in it"
    rows = [(k, f"{prose(k)} {passage if k % 5 == 0 else 'nothing'} {prose(k + 3)}") for k in range(50)] + [(90, passage), (91, passage[:20])]
    left = kept_ids(STAGES["decontamination"](spark, table(spark, rows), folder))
    assert left == [k for k in range(50) if k % 5] + [91]


def test_run_chains_the_stages(spark):
    sf = "/root/testdata/sf0.001"
    packed = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(packed.columns)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = packed.select("doc_id").distinct()
    assert ids.join(docs, "doc_id").count() == ids.count() and 0 < ids.count() < docs.count()
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert fill.where("n > 1024 or n <> end").count() == 0
