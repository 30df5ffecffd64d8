"""Input relations derived from the given tables by plain projections and grouping.

The tables carry no video data, so events, detections, boxes and samples are computed from
``events`` and ``lineitem``; every relation grows with its table. ``SQL`` in
:mod:`kerbline.plans.oracles` states the same relations for the checking engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.functions.labels import with_time_parts, with_time_period
from kerbline.plans import star
from kerbline.schemas import DIM_CAMERA, DIM_VIOLATION_TYPE

AS_OF = "2024-01-15"

CAMERAS = (
    (1, "quay_01", "Quay crossing 1", "Quay street", "47.10125", "8.20250"),
    (2, "quay_02", "Quay crossing 2", "Quay street", "47.10150", "8.20300"),
    (3, "mill_01", "Mill lane", "Mill street", "47.10900", "8.21000"),
    (4, "dale_01", "Dale corner", None, "47.11000", "8.22000"),
    (5, "fern_01", "Fern corner", None, "47.12000", "8.22500"),
    (6, "rise_01", "Rise corner", None, "47.13000", "8.23000"),
    (7, "dark_01", "No position", None, None, None),
)
VIOLATION_TYPES = (
    (1, "no_helmet", "Rider without helmet", 3),
    (2, "no_helmet_passenger", "Passenger without helmet", 2),
    (3, "never_seen", "No facts for this type", 1),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_violation_events(events: DataFrame) -> DataFrame:
    """Row-wise mapping of the raw events, usable on a stream as well."""
    n = F.col("event_id")
    camera = (
        F.when(n % 1000 == 999, "dale_01")
        .when(n % 5000 == 4998, "fern_01")
        .when(n % 4 == 0, "quay_01")
        .when(n % 4 == 1, "quay_02")
        .when(n % 4 == 2, "mill_01")
        .otherwise("not_listed")
    )
    kind = (
        F.when(F.col("event_type") == "error", "no_helmet_passenger")
        .when(F.col("event_type") == "view", "other")
        .otherwise("no_helmet")
    )
    return events.select(
        n.cast("string").alias("event_id"),
        (F.col("user_id") % 20).cast("int").alias("track_id"),
        F.col("ts").cast("timestamp").alias("event_timestamp"),
        camera.alias("camera_id"),
        kind.alias("violation_type"),
        ((45 + n % 55).cast("double") / 100).alias("confidence"),
        (n % 600).cast("int").alias("bbox_x1"),
        (n % 300).cast("int").alias("bbox_y1"),
        (n % 600 + 60).cast("int").alias("bbox_x2"),
        (n % 300 + 120).cast("int").alias("bbox_y2"),
        (n * 5).cast("int").alias("frame_number"),
        F.col("value").alias("processing_latency_ms"),
    )


def violation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_violation_events(table(spark, sf_dir, "events"))


def redelivered(events: DataFrame) -> DataFrame:
    """Events with repeats, row by row: every fifth is delivered twice, every seventh again five
    seconds later under its id, and every eleventh has no track."""
    n = F.col("event_id").cast("bigint")
    none = F.array().cast("array<int>")
    delays = F.concat(
        F.array(F.lit(0)), F.when(n % 5 == 0, F.array(F.lit(0))).otherwise(none), F.when(n % 7 == 0, F.array(F.lit(5))).otherwise(none)
    )
    later = F.timestamp_micros(F.unix_micros("event_timestamp") + F.col("_delay") * 1000000)
    track = F.when(n % 11 != 0, F.col("track_id"))
    return (
        events.withColumn("_delay", F.explode(delays))
        .withColumns({"event_timestamp": later, "track_id": track})
        .drop("_delay")
    )


def enriched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_time_period(with_time_parts(violation_events(spark, sf_dir)))


def _values(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A literal relation. Its size is known to the optimizer, unlike that of an RDD."""
    text = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in rows)
    columns = [part.strip().split(" ", 1) for part in re.split(r",\s(?=[a-z])", schema)]
    names = ", ".join(n for n, _ in columns)
    casts = [F.col(n).cast(t).alias(n) for n, t in columns]
    return spark.sql(f"SELECT * FROM VALUES {text} AS t({names})").select(*casts)


def dim_camera(spark: SparkSession) -> DataFrame:
    return _values(spark, CAMERAS, DIM_CAMERA)


def dim_violation_type(spark: SparkSession) -> DataFrame:
    return _values(spark, VIOLATION_TYPES, DIM_VIOLATION_TYPE)


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.fact_rows(enriched_events(spark, sf_dir), dim_camera(spark), dim_violation_type(spark))


def line_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with its number within the order, as line numbers repeat there.

    Boxes of all kinds are row-wise projections of this relation. A query that reads them
    more than once stages the slots first, so the lines are shuffled once.
    """
    within = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(within).alias("ln"), F.col("l_partkey").alias("p"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections_from(line_slots(spark, sf_dir))


def detections_from(slots: DataFrame) -> DataFrame:
    """Boxes of 4 cameras: lines 1-2 are motorcycles, the others riders; tracks live 40 frames."""
    ln, p, frame = F.col("ln"), F.col("p"), F.col("frame_number")
    left = F.when(ln % 2 == 1, 100).otherwise(400)
    vehicle = ln <= 2
    return (
        slots.withColumn("camera_id", F.col("l_orderkey") % 4)
        .withColumn("frame_number", F.expr("l_orderkey div 4") + 1)
        .select(
            "camera_id",
            F.lit("s0").alias("session_id"),
            "frame_number",
            ln.alias("det_idx"),
            (F.expr("frame_number div 40") * 100 + ln).alias("track_id"),
            F.when(vehicle, 2).when(p % 10 < 7, 1).otherwise(0).alias("class_id"),
            ((30 + p % 70).cast("double") / 100).alias("confidence"),
            (left + F.when(vehicle, 0).otherwise(p % 80)).cast("double").alias("x1"),
            F.when(vehicle, 200).otherwise(120 + p % 60).cast("double").alias("y1"),
            (left + F.when(vehicle, 120).otherwise(60 + p % 80)).cast("double").alias("x2"),
            F.when(vehicle, 300).otherwise(240 + p % 60).cast("double").alias("y2"),
        )
    )


def frames(dets: DataFrame) -> DataFrame:
    """Every frame 1..last of each camera session, also those without a detection.

    The range is generated per block of frames so that one long session is not one task. The blocks are
    a few bytes each, so their partitions are given by number: adaptive execution would put all of them into one task.
    """
    block = 4096
    parts = int(dets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = dets.groupBy("camera_id", "session_id").agg(F.max("frame_number").alias("last"))
    blocks = last.withColumn("b", F.explode(F.sequence(F.lit(0), F.expr(f"last div {block}"))))
    spread = blocks.repartition(parts, "camera_id", "session_id", "b")
    first = F.greatest(F.col("b") * block, F.lit(1))
    final = F.least(F.col("last"), F.col("b") * block + block - 1)
    return spread.filter(first <= final).select(
        "camera_id", "session_id", F.explode(F.sequence(first, final)).alias("frame_number")
    )


def _box_slots(slots: DataFrame) -> DataFrame:
    return slots.withColumn("sequence_id", (F.col("l_orderkey") % 3).cast("string")).withColumn(
        "frame", F.expr("l_orderkey div 3") + 1
    )


def gt_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gt_boxes_from(line_slots(spark, sf_dir))


def gt_boxes_from(slots: DataFrame) -> DataFrame:
    """Truth boxes: one slot per line, slots 1000 px apart."""
    ln = F.col("ln")
    return (
        _box_slots(slots)
        .filter(F.col("p") % 19 != 0)
        .select(
            "sequence_id",
            "frame",
            (F.expr("frame div 50") * 100 + ln).alias("id"),
            (ln * 1000).cast("double").alias("bb_left"),
            F.lit(100.0).alias("bb_top"),
            F.lit(100.0).alias("bb_w"),
            F.lit(200.0).alias("bb_h"),
            F.lit(1.0).alias("conf"),
            (ln % 3).cast("int").alias("class_id"),
        )
    )


def pred_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pred_boxes_from(line_slots(spark, sf_dir))


def pred_boxes_from(slots: DataFrame) -> DataFrame:
    """Predicted boxes: misses, shifts that pass and fail the threshold, changed ids."""
    ln, p = F.col("ln"), F.col("p")
    return (
        _box_slots(slots)
        .filter(p % 17 != 0)
        .select(
            "sequence_id",
            "frame",
            (F.expr("frame div 50") * 100 + ln + F.when(p % 29 == 0, 1000000).otherwise(0)).alias("id"),
            (ln * 1000 + (p % 9) * 8).cast("double").alias("bb_left"),
            F.lit(100.0).alias("bb_top"),
            F.lit(100.0).alias("bb_w"),
            F.lit(200.0).alias("bb_h"),
            ((30 + p % 70).cast("double") / 100).alias("conf"),
            (ln % 3).cast("int").alias("class_id"),
        )
    )


def crowded(boxes: DataFrame) -> DataFrame:
    """Truth or predicted boxes with neighbouring slots pushed together: slots 1 and 2, 3 and 4, ... overlap, so a frame's
    boxes have several partners and the best match is not each box's own best. The confidence makes shifts unlike."""
    slot = F.col("id") % 100
    shift = F.col("bb_left") - slot * 1000
    own = F.when(F.col("conf") < 1, F.col("conf") / 10).otherwise(0.0)
    return boxes.withColumn("bb_left", (F.expr("(id % 100 + 1) div 2") * 1000 + (slot + 1) % 2 * 36).cast("double") + shift + own)


def frame_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    total = F.col("inference_ms") + F.col("tracking_ms") + F.col("violation_ms")
    return (
        table(spark, sf_dir, "events")
        .select(
            (n % 3).cast("string").alias("run_id"),
            (F.expr("event_id div 3") + 1).alias("frame"),
            (100 + F.col("value")).alias("inference_ms"),
            ((n % 50).cast("double") / 10).alias("tracking_ms"),
            ((n % 9).cast("double") / 100).alias("violation_ms"),
        )
        .withColumn("total_ms", total)
        .withColumn("fps", F.when(F.col("total_ms") > 0, 1000 / F.col("total_ms")).otherwise(0.0))
    )


def resource_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.when(n % 2 == 0, "pipeline").otherwise("spark").alias("component"),
        n.alias("sample_no"),
        F.col("value").alias("cpu_percent"),
        (700 + n % 300).cast("double").alias("memory_mb"),
    )
