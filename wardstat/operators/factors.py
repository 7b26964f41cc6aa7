"""Categorical columns as factors: their levels, counted in one pass, and codes by level."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A column with more levels than this is no factor; their dictionary lives on the driver.
MAX_LEVELS = 100_000

_WHOLE = ("tinyint", "smallint", "int", "bigint")


def present_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those of ``columns`` that ``df`` has, with a warning for each of the others."""
    for name in columns:
        if name not in df.columns:
            warnings.warn(f"column {name} not found in the table", stacklevel=3)
    return [c for c in columns if c in df.columns]


def cells(columns: Sequence[str]) -> Column:
    """The values of several columns as one array of (variable, level), levels as text."""
    return F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("string").alias("level")) for c in columns])


def factor_levels(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """Levels of all columns as (variable, level, code, n), counted together in one pass.

    Codes start at 1 and follow the order of the values: numbers by size, text by its bytes. Missing
    values are no level. ``weight`` counts a row as often as that column says. Columns that are not
    there are left out with a warning.
    """
    known = present_columns(df, columns)
    kinds = dict(df.dtypes)
    if not known:
        return df.sparkSession.createDataFrame([], "variable string, level string, code int, n bigint")
    counts = _level_counts(df, known, weight)
    numeric = [c for c in known if kinds[c] != "string"]
    number = F.when(F.col("variable").isin(numeric), F.expr("try_cast(level as double)"))
    # One row per level from here on.
    order = Window.partitionBy("variable").orderBy(number, "level")
    return counts.select("variable", "level", F.row_number().over(order).alias("code"), "n")


def _level_counts(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    amount = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    exploded = df.select(F.explode(cells(columns)).alias("cell"), amount.alias("_n"))
    return exploded.where("cell.level is not null").groupBy("cell.variable", "cell.level").agg(F.sum("_n").alias("n"))


def level_dictionary(df: DataFrame, columns: Sequence[str], max_levels: int = MAX_LEVELS) -> dict[str, list]:
    """The sorted levels of each column on the driver: whole numbers as such, all else as text."""
    kinds = dict(df.dtypes)
    known = present_columns(df, columns)
    found: dict[str, list] = {c: [] for c in known}
    rows = _level_counts(df, known).select("variable", "level").limit(max_levels + 1).collect() if known else []
    if len(rows) > max_levels:
        raise ValueError(f"more than {max_levels} levels: these columns are no factors")
    for variable, level in rows:
        found[variable].append(int(level) if kinds[variable] in _WHOLE else level)

    def place(column: str):
        # The order of the codes above: numbers by size, text by its bytes.
        return (lambda v: v) if kinds[column] in _WHOLE else (lambda v: v.encode()) if kinds[column] == "string" else _by_number

    return {c: sorted(levels, key=place(c)) for c, levels in found.items()}


def _by_number(level: str) -> tuple:
    try:
        return 1, float(level), level.encode()
    except ValueError:
        return 0, 0.0, level.encode()


def level_code(column: str, levels: Sequence) -> Column:
    """Place of a value among ``levels``, from 1; NULL for a missing or unknown value."""
    if not levels:
        return F.lit(None).cast("int")
    value = F.col(f"`{column}`").cast("bigint" if isinstance(levels[0], int) else "string")
    return F.nullif(F.array_position(F.lit(list(levels)), value), F.lit(0).cast("bigint")).cast("int")


def to_factors(df: DataFrame, columns: Sequence[str], levels: dict[str, list] | None = None) -> DataFrame:
    """Replace the columns by the codes of their levels; a column that is not there is warned about.

    With ``levels`` (from :func:`level_dictionary`) the same codes serve several tables; values that
    the dictionary does not have become NULL, as missing ones are.
    """
    known = present_columns(df, columns)
    levels = level_dictionary(df, known) if levels is None else levels
    return df.withColumns({c: level_code(c, levels[c]) for c in known if c in levels})
