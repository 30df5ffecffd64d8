"""Per-box projections and per-frame associations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.functions import geometry as g
from kerbline.functions.labels import class_name, violation_type
from kerbline.params import (
    CLASS_NAMES,
    DETECTOR_CONFIDENCE,
    DISPLAY_IOA,
    HELMET,
    MOTORCYCLE,
    NO_HELMET,
    RIDER_CLASSES,
    TRACKER_ACTIVATION,
)

FRAME = ("camera_id", "session_id", "frame_number")
BOX = ("x1", "y1", "x2", "y2")


def frame_stride(detections: DataFrame, stride: int) -> DataFrame:
    """Keep source frames n, 2n, 3n... and renumber them 1, 2, 3..."""
    n = F.col("frame_number")
    kept = detections.filter(n % stride == 0)
    return kept.withColumn("source_frame", n).withColumn("frame_number", F.expr(f"frame_number div {stride}"))


def class_names(detections: DataFrame) -> DataFrame:
    c = F.col("class_id")
    return detections.withColumns(
        {"class_name": class_name(c), "lookup_name": class_name(c, unknown="unknown_")}
    )


def confidence_tiers(
    detections: DataFrame, threshold: float = DETECTOR_CONFIDENCE, activation: float = TRACKER_ACTIVATION
) -> DataFrame:
    """Drop boxes below the detector threshold; label the tracker's two tiers."""
    c = F.col("confidence")
    return detections.filter(c >= threshold).withColumn("tier", F.when(c > activation, "HIGH").otherwise("LOW"))


def box_area_center(detections: DataFrame) -> DataFrame:
    b = g.box()
    cx, cy = g.center(b)
    return detections.withColumns({"area": g.area(b), "center_x": cx, "center_y": cy})


def box_clip(detections: DataFrame, width: int, height: int) -> DataFrame:
    """Clamp integer corners to the frame and drop boxes that become empty."""
    low = lambda c: F.greatest(F.lit(0), F.col(c).cast("int"))
    high = lambda c, size: F.least(F.lit(size - 1), F.col(c).cast("int"))
    clipped = detections.withColumns(
        {"x1": low("x1"), "y1": low("y1"), "x2": high("x2", width), "y2": high("y2", height)}
    )
    return clipped.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def trigger_type(detections: DataFrame) -> DataFrame:
    return detections.withColumn("violation_type", violation_type(F.col("class_id")))


def _boxes(detections: DataFrame, classes, prefix: str) -> DataFrame:
    """Frame key plus index and corners of the given classes, corners prefixed."""
    return detections.filter(F.col("class_id").isin(list(classes))).select(
        *FRAME, F.col("det_idx").alias(prefix + "det_idx"), *[F.col(c).alias(prefix + c) for c in BOX]
    )


def with_best_ioa(detections: DataFrame, riders: DataFrame) -> DataFrame:
    """Add ``best_ioa``: the largest IoA of a rider with a motorcycle of its frame, else 0.

    A left join on the frame and a maximum per rider. Grouping by the rider's own columns
    keeps the partitioning of the join, so the riders are shuffled once.
    """
    rider, motorcycle = g.box(), g.box("m_")
    motorcycles = _boxes(detections, [MOTORCYCLE], "m_").drop("m_det_idx").alias("m")
    same_frame = [F.col(f"r.{k}") == F.col(f"m.{k}") for k in FRAME]
    pairs = riders.alias("r").join(motorcycles, [*same_frame, g.overlaps(rider, motorcycle)], "left")
    # No motorcycle: its corners are NULL, and least/greatest would skip them.
    ioa = F.when(F.col("m_x1").isNotNull(), g.ioa(rider, motorcycle))
    return pairs.groupBy(*[F.col(f"r.{c}") for c in riders.columns]).agg(
        F.coalesce(F.max(ioa), F.lit(0.0)).alias("best_ioa")
    )


def riding_semi_join(detections: DataFrame, threshold: float = 0.2, trigger_class: int = NO_HELMET) -> DataFrame:
    """Trigger-class boxes that overlap a motorcycle of the same frame."""
    riders = detections.filter(F.col("class_id") == trigger_class).alias("r")
    motorcycles = _boxes(detections, [MOTORCYCLE], "m_").drop("m_det_idx").alias("m")
    same_frame = [F.col(f"r.{k}") == F.col(f"m.{k}") for k in FRAME]
    hit = g.ioa(g.box(), g.box("m_")) >= threshold
    return riders.join(motorcycles, [*same_frame, hit], "left_semi")


def pair_geometry(detections: DataFrame) -> DataFrame:
    """Overlapping rider x motorcycle pairs of a frame with IoU, IoA and centre distance."""
    riders = _boxes(detections, RIDER_CLASSES, "r_")
    motorcycles = _boxes(detections, [MOTORCYCLE], "m_")
    r, m = g.box("r_"), g.box("m_")
    return (
        riders.join(motorcycles, list(FRAME))
        .filter(g.overlaps(r, m))
        .select(
            *FRAME,
            "r_det_idx",
            "m_det_idx",
            g.iou(r, m).alias("iou"),
            g.ioa(r, m).alias("ioa"),
            g.center_distance(r, m).alias("distance"),
        )
    )


def association_edges(detections: DataFrame, threshold: float = DISPLAY_IOA) -> DataFrame:
    """Rider x motorcycle pairs whose IoA reaches the threshold."""
    pairs = pair_geometry(detections).filter(F.col("ioa") >= threshold)
    return pairs.select(*FRAME, F.col("r_det_idx").alias("rider_idx"), F.col("m_det_idx").alias("moto_idx"), "ioa")


def best_motorcycle(detections: DataFrame, threshold: float = DISPLAY_IOA) -> DataFrame:
    """Per rider the motorcycle of highest IoA, the lowest index on ties; -1 without any."""
    pairs = pair_geometry(detections).filter(F.col("ioa") > 0)
    best = pairs.groupBy(*FRAME, F.col("r_det_idx").alias("rider_idx")).agg(
        F.max_by(
            F.struct(F.col("m_det_idx").alias("moto_idx"), "ioa", "iou"),
            F.struct("ioa", -F.col("m_det_idx")),
        ).alias("b")
    )
    riders = detections.filter(F.col("class_id").isin(list(RIDER_CLASSES))).select(
        *FRAME, F.col("det_idx").alias("rider_idx")
    )
    ioa = F.coalesce("b.ioa", F.lit(0.0))
    return riders.join(best, [*FRAME, "rider_idx"], "left").select(
        *FRAME,
        "rider_idx",
        F.coalesce("b.moto_idx", F.lit(-1)).alias("moto_idx"),
        ioa.alias("ioa"),
        F.coalesce("b.iou", F.lit(0.0)).alias("iou"),
        (ioa >= threshold).alias("passed"),
    )


def association_rate(detections: DataFrame, threshold: float = DISPLAY_IOA) -> DataFrame:
    """Riders, motorcycles and associated riders of each frame."""
    riders = detections.filter(F.col("class_id").isin(list(RIDER_CLASSES))).select(*FRAME, "det_idx", *BOX)
    linked = with_best_ioa(detections, riders).groupBy(*FRAME).agg(
        F.count("*").alias("riders"), F.count_if(F.col("best_ioa") >= threshold).alias("associated")
    )
    motorcycles = detections.groupBy(*FRAME).agg(F.count_if(F.col("class_id") == MOTORCYCLE).alias("motorcycles"))
    return motorcycles.join(linked, list(FRAME), "left").na.fill(0, ["riders", "associated"])


def frame_summary(detections: DataFrame, frames: DataFrame) -> DataFrame:
    """Counters of every frame, zero for frames without a detection."""
    c = F.col("class_id")
    counts = detections.groupBy(*FRAME).agg(
        F.count("*").alias("total"),
        F.count_if(c == HELMET).alias("helmets"),
        F.count_if(c == NO_HELMET).alias("no_helmets"),
        F.count_if(c == MOTORCYCLE).alias("motorcycles"),
    )
    return frames.join(counts, list(FRAME), "left").na.fill(0, ["total", "helmets", "no_helmets", "motorcycles"])


def detection_summary(detections: DataFrame, frames: DataFrame) -> DataFrame:
    """Totals and means per frame, overall and per class; empty frames count in the means."""
    n_frames = frames.agg(F.nullif(F.count("*"), F.lit(0))).scalar()
    c = F.col("class_id")
    totals = detections.agg(
        F.count("*").alias("ALL"), *[F.count_if(c == i).alias(name) for i, name in CLASS_NAMES.items()]
    )
    return totals.unpivot([], ["ALL", *CLASS_NAMES.values()], "class_name", "total").select(
        "class_name", "total", F.round(F.col("total") / n_frames, 2).alias("mean_per_frame")
    )


def tracking_summary(detections: DataFrame, frames: DataFrame) -> DataFrame:
    """Unique track ids, mean and maximum of distinct active ids per frame."""
    tracked = detections.filter(F.col("track_id").isNotNull())
    seen = tracked.select(*FRAME, "track_id").distinct()
    active = seen.groupBy(*FRAME).agg(F.count("*").alias("active"))
    tracks = seen.select("camera_id", "session_id", "track_id").distinct().agg(F.count("*")).scalar()
    n_frames = frames.agg(F.nullif(F.count("*"), F.lit(0))).scalar()
    per_frame = active.agg(F.coalesce(F.sum("active"), F.lit(0)).alias("n"), F.max("active").alias("top"))
    return per_frame.select(
        tracks.alias("unique_tracks"),
        F.round(F.col("n") / n_frames, 2).alias("mean_active"),
        F.coalesce("top", F.lit(0)).alias("max_active"),
    )


def class_ratio(detections: DataFrame) -> DataFrame:
    """Helmet to no-helmet ratio and the violating share of riders, per camera."""
    c = F.col("class_id")
    counts = detections.groupBy("camera_id").agg(
        F.count_if(c == HELMET).alias("helmets"), F.count_if(c == NO_HELMET).alias("no_helmets")
    )
    return counts.withColumns(
        {
            "helmet_ratio": F.round(F.col("helmets") / F.expr("nullif(no_helmets, 0)"), 3),
            "violating_pct": F.round(100.0 * F.col("no_helmets") / F.expr("nullif(helmets + no_helmets, 0)"), 2),
        }
    )
