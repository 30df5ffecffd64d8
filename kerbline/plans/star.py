"""Star schema: time dimension, facts, seeds and integrity checks.

Keys need no lookup and no counter: ``time_id`` is the event time in microseconds and the
fact key is the event id itself, so a reload gives the same keys and no key can collide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dim_time_rows(enriched: DataFrame) -> DataFrame:
    """One row per distinct event time."""
    return (
        enriched.filter(F.col("event_timestamp").isNotNull())
        .select(
            F.unix_micros("event_timestamp").alias("time_id"),
            F.col("event_timestamp").alias("full_timestamp"),
            "date",
            "year",
            "month",
            "day_of_week",
            F.col("hour").alias("hour_of_day"),
            F.col("time_period").alias("time_name"),
        )
        .distinct()
        .withColumn("is_weekend", F.col("day_of_week").isin(1, 7))
        .withColumn("is_exam_period", F.lit(False))
    )


def dim_time_new(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates whose timestamp the dimension does not hold yet."""
    return candidates.join(existing.select("full_timestamp"), "full_timestamp", "left_anti")


def fact_rows(enriched: DataFrame, cameras: DataFrame, types: DataFrame) -> DataFrame:
    """Resolve the foreign keys; an unknown camera or type keeps the row with a NULL key.

    The dimensions are not hinted: Spark broadcasts them while their measured size allows it.
    """
    camera_key = cameras.select(F.col("camera_pk").alias("camera_fk"), "camera_id")
    type_key = types.select(
        F.col("type_pk").alias("violation_type_fk"), F.col("type_code").alias("violation_type")
    )
    return (
        enriched.join(camera_key, "camera_id", "left")
        .join(type_key, "violation_type", "left")
        .select(
            F.col("event_id").alias("violation_pk"),
            F.unix_micros("event_timestamp").alias("timestamp_fk"),
            "camera_fk",
            "violation_type_fk",
            "track_id",
            "confidence",
            "bbox_x1",
            "bbox_y1",
            "bbox_x2",
            "bbox_y2",
            "frame_number",
            "processing_latency_ms",
            F.lit(1).alias("violation_count"),
            "hour",
            "minute",
            "day_of_week",
            "date",
            "week_of_year",
            "month",
            "year",
            "time_period",
            F.col("event_timestamp").alias("created_at"),
        )
    )


def seed_dimension(seed: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """Seed rows to insert: key not present yet; of equal keys the first by ``order``."""
    columns = seed.columns
    first = seed.groupBy(key).agg(
        F.min_by(F.struct(*columns), F.col(order)).alias("row")
    )
    return first.select("row.*").join(existing.select(key), key, "left_anti").select(*columns)


def constraint_violations(
    fact: DataFrame, dim_camera: DataFrame, dim_type: DataFrame, dim_time: DataFrame
) -> DataFrame:
    """Rows that break a declared rule, as ``(table_name, rule, key)``."""

    def found(df, table, rule, key):
        return df.select(
            F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key")
        )

    def repeated(df, table, key):
        groups = df.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1")
        return found(groups, table, f"unique {key}", key)

    def missing(df, table, column, key):
        return found(df.filter(F.col(column).isNull()), table, f"not null {column}", key)

    def dangling(column, dim, dim_key):
        known = dim.select(F.col(dim_key).alias(column))
        orphans = fact.filter(F.col(column).isNotNull()).join(known, column, "left_anti")
        return found(orphans, "fact_violations", f"references {column}", "violation_pk")

    parts = [
        repeated(fact, "fact_violations", "violation_pk"),
        repeated(dim_camera, "dim_camera", "camera_id"),
        repeated(dim_type, "dim_violation_type", "type_code"),
        repeated(dim_time, "dim_time", "full_timestamp"),
        missing(fact, "fact_violations", "track_id", "violation_pk"),
        missing(fact, "fact_violations", "confidence", "violation_pk"),
        missing(dim_time, "dim_time", "full_timestamp", "time_id"),
        found(
            dim_type.filter(~F.col("severity_level").between(1, 3)),
            "dim_violation_type",
            "check severity_level",
            "type_pk",
        ),
        dangling("camera_fk", dim_camera, "camera_pk"),
        dangling("violation_type_fk", dim_type, "type_pk"),
        dangling("timestamp_fk", dim_time, "time_id"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
