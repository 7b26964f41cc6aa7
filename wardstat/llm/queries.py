"""The corpus operators as named queries over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstat.llm import decontamination, exact_dedup, hidden_markov, order_minhash, packing, periodic, pii
from wardstat.llm import quality, sharding, suffix_dedup, toxicity, warc, whitening
from wardstat.llm.common import documents, labels


#: A document is called toxic from this score on.
TOXIC_SCORE = 0.3


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("row.doc_id", "class_id", "class_size", "kept")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir).select("doc_id", "text"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality.fit(docs, labels(spark, sf_dir).where(remainder(3) != 1))
    return quality.score(docs, model).select("row.doc_id", "score").select(
        "doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(suffix_dedup.remove_repeats(documents(spark, sf_dir)))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = exact_dedup.exact_dedup_rows(docs)
    return found.select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op6_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return hidden_markov.score(docs, remainder(5) != 1).select(
        "doc_id", (remainder(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decontamination.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("row.doc_id").alias("doc_id"), F.explode("leaks").alias("leak")).select(
        "doc_id", "leak.item_id", F.round("leak.similarity", 6).alias("similarity"), F.col("leak.start").alias("start_word")
    )


def remainder(modulus: int) -> Column:
    """What is left of the id's CRC-32 after division."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, labels(spark, sf_dir).where(remainder(4) != 2))
    scored = toxicity.score(docs, model).select("row.doc_id", "score", "evidence")
    return scored.select(
        "doc_id",
        (remainder(4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted"),
        F.col("evidence.id").alias("nearest"),
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find_pii(documents(spark, sf_dir)))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.drop("stored_digest")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return periodic.report(periodic.periodic_runs(periodic.with_planted_periods(docs)))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows = whitening.quantised(vectors).select("vec_id", "x")
    found = whitening.whiten(rows, whitening.fit(rows))
    return found.select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


QUERIES = {
    "op1_order_minhash": op1_order_minhash,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_quality": op3_quality,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_hidden_markov": op6_hidden_markov,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_pii": op9_pii,
    "op10_sharding": op10_sharding,
    "op11_warc": op11_warc,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL = {
    "op5_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        g AS (SELECT text_sha256, arg_min(doc_id, (-points, doc_id)) AS keep_id, count(*) AS group_size
              FROM t GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM t JOIN g USING (text_sha256)""",
    "op11_warc": """
        WITH t AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        g AS (SELECT payload_digest, min(page_id) AS first FROM t WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest, if(first <> page_id, 'revisit', 'response') AS record_type,
               if(first <> page_id, first, NULL) AS refers_to
        FROM t LEFT JOIN g USING (payload_digest)""",
}
