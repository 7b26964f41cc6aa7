"""Calendar arithmetic on timestamps, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000.0


def as_column(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def calendar_age(at: Column | str, born: Column | str) -> Column:
    """Completed years from ``born`` to ``at``, decided by calendar position, not by day counts.

    Someone born on 29 February completes a year on 1 March of a common year. When ``at`` is
    before ``born`` the result is the negated age of the reversed pair.
    """
    at, born = as_column(at), as_column(born)
    by_date = F.timestamp_diff("YEAR", born.cast("date"), at.cast("date"))
    # Only on the anniversary itself does the time of day decide. The expression is kept short:
    # the JVM does not compile very long generated methods.
    anniversary = (F.dayofmonth(at) == F.dayofmonth(born)) & (F.month(at) == F.month(born))
    clock, birth_clock = _time_of_day(at), _time_of_day(born)
    early = F.when(anniversary & (clock < birth_clock) & (at > born), 1)
    late = F.when(anniversary & (clock > birth_clock) & (at < born), -1)
    same_year = F.year(at) == F.year(born)
    return (by_date - F.when(same_year, 0).otherwise(F.coalesce(early, late, F.lit(0)))).cast("int")


def _time_of_day(t: Column) -> Column:
    return t - F.date_trunc("DAY", t)


def duration_days(start: Column | str, end: Column | str) -> Column:
    """Wall-clock difference in days, as a double."""
    micros = F.timestamp_diff("MICROSECOND", as_column(start), as_column(end))
    return micros.cast("double") / F.lit(MICROS_PER_DAY)
