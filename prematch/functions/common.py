"""Small helpers used by every expression module."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIE_NUDGE = 1.000000000001
OUTCOMES = ("home_win", "draw", "away_win")


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def r6(value: Column | str) -> Column:
    """Round to six places and fold negative zero into zero.

    The factor moves exact decimal ties off the boundary, so that two engines whose last bits differ
    still round the same way.
    """
    return F.round(col(value) * TIE_NUDGE, 6) + F.lit(0.0)


def epoch(value: Column | str) -> Column:
    """Whole seconds since 1970 of a timestamp."""
    return F.unix_seconds(col(value).cast("timestamp"))


def micros(value: Column | str) -> Column:
    return F.unix_micros(col(value).cast("timestamp"))


def all_null(*values: Column | str) -> Column:
    result = col(values[0]).isNull()
    for value in values[1:]:
        result = result & col(value).isNull()
    return result


def compact_codes(rules: dict[str, Column]) -> Column:
    """Array of the codes whose condition holds, in declaration order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules.items()]))
