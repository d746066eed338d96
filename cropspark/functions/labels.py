"""Label cuts, month keys and unit changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cropspark.constants import DB_FLOOR, ELEVATED_Z, N_MONTHS, SEVERE_Z


def stress_class(z: Column) -> Column:
    """2 severe, 1 elevated, 0 otherwise; a missing anomaly is class 0."""
    return F.when(z <= F.lit(SEVERE_Z), F.lit(2)).when(z <= F.lit(ELEVATED_Z), F.lit(1)).otherwise(F.lit(0))


def linear_to_db(power: Column) -> Column:
    return F.when(power > 0, F.lit(10.0) * F.log10(power)).when(power.isNotNull(), F.lit(DB_FLOOR))


def month_start(date: Column) -> Column:
    return F.trunc(date, "month")


def month_keys(date: Column, n: int = N_MONTHS) -> Column:
    """First days of the n months ending with the month of the date, oldest first."""
    last = month_start(date)
    return F.array(*[F.add_months(last, -back) for back in reversed(range(n))])


def month_index(date: Column) -> Column:
    """Calendar month counted from 0."""
    return F.month(date) - F.lit(1)
