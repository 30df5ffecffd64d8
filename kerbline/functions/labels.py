"""Lookup and ladder expressions: names, periods, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbline.params import CLASS_NAMES, DEFAULT_VIOLATION_TYPE, VIOLATION_TYPES

# Inclusive hour ranges of the day periods; every other hour is "malam".
PERIODS = (("pagi", 5, 10), ("siang", 11, 14), ("sore", 15, 17))
NIGHT = "malam"

# Severity and risk labels of the dashboard.
SEVERITY = {3: "Tinggi", 2: "Sedang", 1: "Rendah"}
RISK = ((50, "Tinggi"), (10, "Sedang"), (1, "Rendah"))
NO_RISK = "Aman"


def choose(key: Column, table: dict) -> Column:
    """CASE over a small fixed table, NULL when absent."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


def class_name(class_id: Column, unknown: str = "class_") -> Column:
    return F.coalesce(choose(class_id, CLASS_NAMES), F.concat(F.lit(unknown), class_id.cast("string")))


def violation_type(class_id: Column) -> Column:
    return F.coalesce(choose(class_id, VIOLATION_TYPES), F.lit(DEFAULT_VIOLATION_TYPE))


def time_period(hour: Column) -> Column:
    """Day period of an hour; a NULL hour is night, as is any hour outside the ranges."""
    out = None
    for name, first, last in PERIODS:
        hit = hour.between(first, last)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(NIGHT)


def band(value: Column, base: str | None, steps) -> Column:
    """Label of the highest step whose lower bound is reached; NULL values stay NULL."""
    out = None
    for bound, label in sorted(steps, reverse=True):
        out = F.when(value >= bound, label) if out is None else out.when(value >= bound, label)
    out = F.when(value.isNotNull(), F.lit(base)) if out is None else out.when(value.isNotNull(), F.lit(base))
    return out


def with_time_parts(df, ts: str = "event_timestamp", tz: str | None = None):
    """Calendar columns of an event time (day_of_week 1 = Sunday, ISO week)."""
    at = F.from_utc_timestamp(ts, tz) if tz else F.col(ts)
    return df.withColumns(
        {
            "hour": F.hour(at),
            "minute": F.minute(at),
            "day_of_week": F.dayofweek(at),
            "date": F.to_date(at),
            "week_of_year": F.weekofyear(at),
            "month": F.month(at),
            "year": F.year(at),
        }
    )


def with_time_period(df):
    return df.withColumn("time_period", time_period(F.col("hour")))
