"""A bounded sample of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstat.llm.common import written


def labelled_sample(
    docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, label_col: str, examples: int, name: str
) -> DataFrame:
    """At most ``examples`` labelled rows as (id, label, text), those with the smallest id hashes.

    Rows without label, id or document are left out; of several labels of an id the largest counts,
    of several texts of an id the largest.
    """
    known = labelled.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.dropna().groupBy("id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(examples)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # At most ``examples`` ids, so they go to every task.
    found = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.first("label").alias("label"), F.max("text").alias("text"))
    return written(found, name)
