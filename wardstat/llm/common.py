"""Helpers shared by the corpus operators: reading, writing once, and vectorised words.

The functions over text work on the flat bytes of a whole Arrow column, so that cutting and
hashing words costs a few array passes and no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from wardstat.session import scratch_path, ship_code

#: Bytes of text that one vectorised step works on; a longer document is a step of its own.
STEP_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once below the shared checkpoint folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions the session asks for, never fewer than ``least``."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def schema_of(*parts: StructField | str) -> StructType:
    """A schema from fields and DDL text; fields keep any name and type they have."""
    fields = []
    for part in parts:
        fields += StructType.fromDDL(part).fields if isinstance(part, str) else [part]
    return StructType(fields)


WHOLE_NUMBERS = ("tinyint", "smallint", "int", "bigint")


def ordered_numbers(docs: DataFrame, id_col: str, label: str) -> DataFrame:
    """(id, number) of the distinct ids that are not null: numbers are in the order of the ids.

    Ids are range partitioned, sorted and written once, so the numbers stay as they are.
    """
    ids = docs.select(F.col(f"`{id_col}`").alias("id")).where("id is not null").distinct()
    placed = ids.repartitionByRange("id").sortWithinPartitions("id")
    return written(placed.select("id", F.monotonically_increasing_id().alias("number")), label)


def whole_rows(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as one struct column ``row``, so that no name of its can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A top-level column by exact name."""
    return batch.column(batch.schema.get_field_index(name))


def flat_text(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    if filled.offset:
        filled = pa.concat_arrays([filled])
    _, offsets, data = filled.buffers()
    starts = np.frombuffer(offsets, np.int64)[: len(filled) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return body[starts[0] : starts[-1]], starts - starts[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that cover all rows, each of at most ``limit`` bytes or a single row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def mix(values: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all bits of the value."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


#: Bytes that end a word for the contracts that cut at white space.
NOT_SPACE = np.array([b not in (9, 10, 11, 12, 13, 32) for b in range(256)])
#: Letters, digits and every byte of a non-ASCII character.
WORD_BYTE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: Lower case of the ASCII letters.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of ``inside`` bytes; no run crosses a row."""
    size = len(data)
    mask = inside[data]
    before = np.zeros(size, bool)
    before[1:] = mask[:-1]
    before[offsets[offsets < size]] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.zeros(size, bool)
    after[:-1] = mask[1:]
    after[offsets[offsets > 0] - 1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        base = _BASE + np.uint64(2 * salt)
        powers = np.cumprod(np.full(int(lengths.max()), base, np.uint64))
        values = _BYTE_VALUES[data[np.repeat(starts, lengths) + place]] * powers[place]
        return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def gram_hashes(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of ``size`` consecutive words within a row, and their rows.

    A row with fewer words, but at least one, gives one hash over all of its words.
    """
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, rows.dtype)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        whole = np.zeros(n, bool)
        for step in range(size):
            left = max(n - step, 0)
            part = np.zeros(n, np.uint64)
            part[:left] = hashes[step:]
            same = np.zeros(n, bool)
            same[:left] = rows[step:] == rows[:left]
            total = np.where(same, total * _BASE + part, total)
            whole = same
        first = np.ones(n, bool)
        first[1:] = rows[1:] != rows[:-1]
        short = np.bincount(rows)[rows] < size
        keep = whole | (first & short)
        return mix(total[keep]), rows[keep]
