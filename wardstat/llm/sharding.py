"""Balanced sharding by sampled splitters, in DataFrame operations only.

Rows are ordered by (digest of the text, id), so that equal texts lie next to each other. A sample
of keys, drawn with a probability in proportion to the row's size, gives quantile boundaries that
cut this order into many ranges of about equal bytes. Ranges that turn out overfull are cut again
by a denser sample of their own. Each range is then numbered by itself, and the totals of the
ranges before it turn places in a range into places in the whole order. Shard boundaries are the
exact byte quantiles of that order, so the sample decides how the work is spread, not the result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardstat.llm.common import partitions_for, written

#: Rows a range should have, and the most ranges that are cut (their borders are a constant of the plan).
RANGE_ROWS, RANGES = 1_000_000, 8192
#: Keys drawn per range, on average.
DRAWS = 24
#: A range with more than this multiple of the mean bytes is cut again.
OVERFULL = 1.5


def _range_of(key: Column, borders: list, id_type: str) -> Column:
    """Number of borders that are not above ``key``, by binary search in a constant array."""
    if not borders:
        return F.lit(0)
    # One constant, folded by the optimizer; its length is the number of ranges.
    text = json.dumps([{"digest": a, "id": b} for a, b in borders])
    table = F.from_json(F.lit(text), f"array<struct<digest:string,id:{id_type}>>")
    steps, step = [], 1
    while step <= len(borders):
        steps.insert(0, step)
        step *= 2

    def advance(place: Column, width: Column) -> Column:
        ahead = place + width
        fits = (ahead <= F.lit(len(borders))) & (F.element_at(table, F.least(ahead, F.lit(len(borders)))) <= key)
        return F.when(fits, ahead).otherwise(place)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), advance)


def _borders(rows: DataFrame, ranges: int, draws: int, total: int, seed: int) -> list:
    """Quantile boundaries of a size-weighted sample; at most about ``ranges * draws`` keys are drawn."""
    if ranges < 2 or not total:
        return []
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(ranges * draws / total))
    unit = (F.xxhash64("digest", "id", "salt", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))
    drawn = rows.where(unit < chance).select(F.struct("digest", "id").alias("key"))
    tiles = drawn.select("key", F.ntile(ranges).over(Window.orderBy("key")).alias("tile"))
    first = tiles.groupBy("tile").agg(F.min("key").alias("key")).where("tile > 1").orderBy("key")
    found = [(r["key"]["digest"], r["key"]["id"]) for r in first.collect()]
    return [b for k, b in enumerate(found) if not k or b != found[k - 1]]


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", draws: int = DRAWS) -> DataFrame:
    """Deal the rows of ``docs`` to ``shards`` shards of near equal bytes.

    Returns ``id_col``, ``size`` (UTF-8 bytes of the text, null as none, plus 1), ``text_crc32``,
    ``law``, ``shard`` and ``slot``, the row's place in its shard. A row goes to the shard in which
    the middle of its bytes falls, so two shards differ by less than the size of one row at either
    border. Ids of any type are kept; whole numbers are ordered as such, others as text. Null ids come
    before all others of the same text; wholly equal rows take neighbouring slots. A null text is as
    large as an empty one; texts count whole, however long. Other columns are not read, so their names
    cannot clash. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # Ids other than whole numbers are ordered as text.
    id_type = "bigint" if docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string"
    rows = docs.select(
        F.col(f"`{id_col}`").alias("own_id"),
        F.col(f"`{id_col}`").cast(id_type).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("digest"),
        F.monotonically_increasing_id().alias("salt"),
    )
    rows = written(rows, "shard-rows")
    total, count = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    wanted = max(4 * shards, 2 * partitions_for(docs), (count or 0) // RANGE_ROWS)
    ranges = min(RANGES, wanted, max(1, (count or 0) // 16))
    key = F.struct("digest", "id")
    ranged = rows.withColumn("range", _range_of(key, _borders(rows, ranges, draws, total or 0, 1), id_type))

    # Second cut: only ranges far above the mean draw again, inside themselves and more densely.
    loads = ranged.groupBy("range").agg(F.sum("size").alias("bytes"))
    mean = max(1.0, (total or 0) / ranges)
    overfull = {r["range"]: r["bytes"] for r in loads.where(F.col("bytes") > OVERFULL * mean).collect()}
    if overfull:
        heavy = sum(overfull.values())
        inside = ranged.where(F.col("range").isin(list(overfull)))
        finer = _borders(inside, min(RANGES, int(2 * heavy / mean) + 1), draws, heavy, 2)
        ranged = ranged.withColumn("cut", F.when(F.col("range").isin(list(overfull)), _range_of(key, finer, id_type)).otherwise(0))
    else:
        ranged = ranged.withColumn("cut", F.lit(0))

    # A key that alone overfills its range (wholly equal rows) is dealt on by its salt.
    pieces = ranged.groupBy("range", "cut").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    # Pieces of three times the mean, so there are fewer of them than ranges.
    stubborn = {f"{r['range']}:{r['cut']}": int(r["bytes"] / mean) + 1 for r in pieces.where(F.col("bytes") > 2 * OVERFULL * mean).collect()}
    deal = F.lit(0)
    if stubborn:
        parts = F.try_element_at(F.from_json(F.lit(json.dumps(stubborn)), "map<string,int>"), F.concat_ws(":", "range", "cut"))
        deal = F.pmod(F.xxhash64("salt"), F.coalesce(parts, F.lit(1))).cast("int")
    return _placed(ranged.withColumn("deal", deal), shards, total or 0, id_col)


def _placed(ranged: DataFrame, shards: int, total: int, id_col: str) -> DataFrame:
    """Places in the whole order from places in each range and the totals of the ranges before."""
    piece = ["range", "cut", "deal"]
    before = Window.orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    # One row per piece: at most ``RANGES`` ranges, as many cuts, and a part for every mean of bytes.
    offsets = ranged.groupBy(*piece).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).select(
        *piece,
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
    )
    inside = Window.partitionBy(*piece).orderBy("digest", "id", "salt")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select(
        "own_id", "size", "text_crc32", *piece,
        F.row_number().over(inside).alias("place"),
        F.sum("size").over(upto).alias("bytes_upto"),
    )
    middle = 2 * (F.col("bytes_before") + F.col("bytes_upto")) - F.col("size")
    placed = local.join(F.broadcast(offsets), piece).select(
        "own_id", "size", "text_crc32",
        F.least(F.lit(shards - 1), F.floor(middle.cast("double") * shards / (2.0 * max(1, total)))).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("place") - 1).alias("row"),
    )
    placed = written(placed, "shard-places")
    starts = placed.groupBy("shard").agg(F.min("row").alias("start"))
    return placed.join(F.broadcast(starts), "shard").select(
        F.col("own_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("start")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
