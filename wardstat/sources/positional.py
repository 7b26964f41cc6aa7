"""Row positions of files, alignment by position, and single ordered files written by many tasks."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardstat.operators.ordered import running_totals
from wardstat.session import materialize, scratch_path, ship_code, small_side
from wardstat.sources.csvfiles import _READ, _WRITE

ROW = "row_number"


def numbered_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, name: str = ROW, split_bytes: int | None = None
) -> DataFrame:
    """Rows of CSV files with a header, and their position from 0 in ``name``.

    Rows count in order of file names and of their place in the file, whichever tasks read them. A
    task reads splits in any order, but a split's rows in theirs; so a row's number is its place in
    its split plus the rows of all splits before. The rows are written once with their split, since a
    second scan may be cut otherwise, and splits are counted from what was written. Lines must not
    contain line breaks. ``split_bytes`` sets the size of the splits for this read.
    """
    session = spark
    if split_bytes is not None:
        session = spark.newSession()
        session.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
        session.conf.set("spark.sql.files.openCostInBytes", "0")
        session.conf.set("spark.sql.files.minPartitionNum", "1")
    names = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).names
    read = session.read.options(**_READ).schema(schema).csv(path)
    placed = read.select(
        *[F.col(f"`{c}`") for c in names],
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_place"),
    )
    stored = scratch_path(spark, "numbered")
    placed.write.parquet(stored)
    rows = spark.read.schema(placed.schema).parquet(stored)
    splits = rows.groupBy("_file", "_split").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    # One row per split; ordered in slices, so that their number does not matter either.
    upto = running_totals(splits, ["_file", "_split"], {"_rows": "_upto"})
    offsets = small_side(upto.select("_file", "_split", "_first", (F.col("_upto") - F.col("_rows")).alias("_before")))
    numbered = rows.join(offsets, ["_file", "_split"])
    return numbered.select(*[F.col(f"`{c}`") for c in names], (F.col("_place") - F.col("_first") + F.col("_before")).alias(name))


def numbered_rows(df: DataFrame, order: Sequence[str], name: str = ROW) -> DataFrame:
    """Add the position from 0 along ``order``, which must tell all rows apart."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_totals(one, order, {"_one": "_upto"}).select(*df.columns, (F.col("_upto") - 1).alias(name))


def align_by_position(left: DataFrame, right: DataFrame, on: str = ROW, strict: bool = True) -> DataFrame:
    """Columns of two numbered tables side by side, row by row.

    With ``strict`` both must have the same number of rows, as two files of one table do; without it
    rows that the right table lacks get NULL, and rows that the left one lacks drop out.
    """
    if strict:
        rows = left.count(), right.count()
        if rows[0] != rows[1]:
            raise ValueError(f"tables of {rows[0]} and {rows[1]} rows cannot be aligned by position")
    return left.join(right, on, "inner" if strict else "left")


def _csv_line(columns: Sequence[str], time_zone: str) -> Column:
    options = {k: str(v) for k, v in _WRITE.items() if k != "header"} | {"timeZone": time_zone}
    return F.to_csv(F.struct(*[F.col(f"`{c}`") for c in columns]), options)


def _digits_before(row: Column) -> Column:
    """Digits of all the numbers from 0 to ``row`` - 1."""
    zero = F.lit(0).cast("bigint")
    return sum((F.greatest(zero, row - 10**k) for k in range(1, 19)), row)


def _laid_out(df: DataFrame, order: Sequence[str], index: str | None) -> tuple[DataFrame, bytes]:
    """Formatted lines as (_row, _line, _start) with their place in the one file, and its header."""
    line = _csv_line(df.columns, df.sparkSession.conf.get("spark.sql.session.timeZone"))
    formatted = df.select(*[F.col(f"`{c}`").alias(f"_key{k}") for k, c in enumerate(order)], line.alias("_line"))
    counted = formatted.withColumns({"_one": F.lit(1).cast("bigint"), "_bytes": (F.octet_length("_line") + 1).cast("bigint")})
    keys = [f"_key{k}" for k in range(len(order))]
    ended = running_totals(counted, keys, {"_one": "_upto", "_bytes": "_end"})
    names = ([index] if index is not None else []) + df.columns
    head = (",".join('"' + n.replace('"', '""') + '"' if set(n) & set(',"\r\n') else n for n in names) + "\n").encode()
    row, start = F.col("_upto") - 1, F.col("_end") - F.col("_bytes") + len(head)
    if index is None:
        return ended.select(row.alias("_row"), "_line", start.alias("_start")), head
    # A number and a comma lead each line, so the numbers before shift it by their digits and commas.
    shifted = start + _digits_before(row) + row
    return ended.select(row.alias("_row"), F.concat(row.cast("string"), F.lit(","), "_line").alias("_line"), shifted.alias("_start")), head


def write_csv_file(df: DataFrame, path: str, order: Sequence[str], index: str | None = None) -> int:
    """Write ``df`` as one CSV file at ``path``, sorted by ``order``, and return its size in bytes.

    With ``index`` a first column of that name (``""`` as data frames have it) numbers the rows from
    0. ``order`` must tell all rows apart; then the file is the same, byte by byte, however many
    tasks write it.

    Rows are formatted, range partitioned and written once; running totals of rows and bytes give
    each line its number and its place in the file. All tasks write their lines there at the same
    time, and a task that is repeated writes the same bytes again. The file appears under its name only
    when it is complete. ``path`` must lie on a file system that all executors share and that can
    write at any place; for stores that cannot, see :func:`write_csv_parts`.
    """
    spark = df.sparkSession
    target = "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
    if "://" in target:
        raise ValueError("writing into one file from many tasks needs a shared file system; use write_csv_parts")
    rows, head = _laid_out(df, order, index)
    lines = materialize(rows.select("_line", "_start"))
    end = lines.agg(F.max(F.col("_start") + F.octet_length("_line") + 1)).first()[0]
    total = len(head) if end is None else end
    partial = f"{target}._partial"
    with open(partial, "wb") as out:
        out.write(head)
        out.truncate(total)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        with open(partial, "r+b") as out:
            for batch in batches:
                for line, start in zip(batch.column("_line").to_pylist(), batch.column("_start").to_pylist()):
                    if out.tell() != start:
                        out.seek(start)
                    out.write(line.encode() + b"\n")
                    written += 1
        yield pa.RecordBatch.from_pydict({"written": pa.array([written], pa.int64())})

    ship_code(spark)
    lines.mapInArrow(task, "written long").agg(F.sum("written")).collect()
    os.replace(partial, target)
    return total


def write_csv_parts(df: DataFrame, path: str, order: Sequence[str], index: str | None = None) -> None:
    """The file of :func:`write_csv_file` in parts below the folder ``path``, for any store.

    The names of the parts follow their order and only the first one holds the header, so joining them
    by name gives the one file.
    """
    rows, head = _laid_out(df, order, index)
    first = df.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("_row"), F.lit(head.decode()[:-1]).alias("_line"))
    whole = first.unionByName(rows.select("_row", "_line"))
    whole.repartitionByRange("_row").sortWithinPartitions("_row").select("_line").write.text(path)
