"""Condition co-occurrence as pair counts, edges and nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardstat.functions.labels import cap_at
from wardstat.sources.tables import FLAGS


def cooccurrence(df: DataFrame, flags: Sequence[str] = FLAGS, by: str | None = None) -> DataFrame:
    """Rows in which both conditions are set, for every ordered pair, as (``a``, ``b``, ``n``).

    The diagonal holds the plain counts and zero cells are present. Each row contributes one
    record per condition it has, summed over all flags on the map side: no self join, no pair
    records, and the only exchange carries one partial row per condition and task.
    """
    keys = [by] if by else []
    df = df.where(F.col(by).isNotNull()) if by else df
    present = ", ".join(f"if(`{f}` <> 0, '{f}', null)" for f in flags)
    bits = [f"if(`{f}` <> 0, 1L, 0L) as `{f}`" for f in flags]
    # The empty name marks every row once, so a group without any condition stays in the result.
    marks = df.selectExpr(*keys, f"explode(array_compact(array('', {present}))) as a", *bits)
    counted = marks.groupBy(*keys, "a").agg(*[F.expr(f"sum(`{f}`) as `{f}`") for f in flags])

    # At most one entry per condition and group: spread them over the full grid of pairs.
    entries = F.collect_list(F.struct("a", F.array(*flags).alias("sums")))
    tables = counted.groupBy(*keys).agg(F.map_from_entries(entries).alias("table"))
    names = F.lit(list(flags))
    firsts = tables.select(*keys, F.explode(names).alias("a"), "table")
    pairs = firsts.select(*keys, "a", F.posexplode(names).alias("i", "b"), F.try_element_at("table", F.col("a")).alias("sums"))
    return pairs.select(*keys, "a", "b", F.coalesce(F.get("sums", F.col("i")), F.lit(0)).cast("bigint").alias("n"))


def network_edges(pairs: DataFrame, by: str | None = None, unique: bool = False) -> DataFrame:
    """Edges with a weight relative to the heaviest one; loops and empty pairs are left out.

    Both directions are emitted unless ``unique`` keeps one.
    """
    keys = [by] if by else []
    wanted = (F.col("a") < F.col("b")) if unique else (F.col("a") != F.col("b"))
    heaviest = F.max("weight").over(Window.partitionBy(*keys))
    return (
        pairs.where(wanted & (F.col("n") > 0))
        .select(*keys, F.col("a").alias("from"), F.col("b").alias("to"), F.col("n").alias("weight"))
        .withColumn("weight_pct", F.col("weight") / heaviest)
    )


def network_nodes(pairs: DataFrame, by: str | None = None, diagonal: bool = True, cap: float = 60.0) -> DataFrame:
    """Nodes with their total, share of all totals in percent, and capped drawing size."""
    keys = [by] if by else []
    counted = pairs if diagonal else pairs.where(F.col("a") != F.col("b"))
    totals = counted.groupBy(*keys, F.col("a").alias("name")).agg(F.sum("n").alias("total_cooccurrences"))
    whole = F.nullif(F.sum("total_cooccurrences").over(Window.partitionBy(*keys)), F.lit(0))
    share = F.col("total_cooccurrences") / whole * 100.0
    return totals.withColumn("total_pct", share).withColumn("node_size", cap_at("total_pct", cap))
