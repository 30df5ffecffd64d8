"""Tracking boxes as headerless text: frame, id, left, top, width, height, conf, class, -1, -1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.operators.ordered import dense_number

MOT_FIELDS = ("frame", "id", "bb_left", "bb_top", "bb_w", "bb_h", "conf", "class_id")
BOX_COLUMNS = ("sequence_id", *MOT_FIELDS)


def parse_mot_lines(lines: DataFrame, classes: Sequence[int] | None = None) -> DataFrame:
    """Text in ``value`` to boxes. Lines of fewer than 7 fields are skipped.

    A missing class is -1. An empty class list means no filter.
    """
    parts = F.split("value", ",")
    types = ("bigint", "bigint", "double", "double", "double", "double", "double")
    fields = [F.trim(parts[i]).try_cast(t).alias(n) for i, (n, t) in enumerate(zip(MOT_FIELDS, types))]
    class_id = F.when(F.size(parts) > 7, F.trim(F.get(parts, F.lit(7))).try_cast("int")).otherwise(-1)
    boxes = lines.filter(F.size(parts) >= 7).select("sequence_id", *fields, class_id.alias("class_id"))
    return boxes.filter(F.col("class_id").isin(list(classes))) if classes else boxes


def read_mot(spark: SparkSession, path: str, classes: Sequence[int] | None = None) -> DataFrame:
    """Read files below ``path``; a partition folder ``sequence_id=...`` names the sequence."""
    lines = spark.read.schema("value STRING, sequence_id STRING").text(path)
    return parse_mot_lines(lines, classes)


def _mot_rows(detections: DataFrame, box_id) -> DataFrame:
    return detections.select(
        F.concat_ws("_", "camera_id", "session_id").alias("sequence_id"),
        F.col("frame_number").alias("frame"),
        box_id.alias("id"),
        F.round("x1", 2).alias("bb_left"),
        F.round("y1", 2).alias("bb_top"),
        F.round(F.col("x2") - F.col("x1"), 2).alias("bb_w"),
        F.round(F.col("y2") - F.col("y1"), 2).alias("bb_h"),
        F.round("confidence", 4).alias("conf"),
        "class_id",
        F.lit(-1).alias("y"),
        F.lit(-1).alias("z"),
    )


def mot_pred_rows(detections: DataFrame) -> DataFrame:
    """Tracked boxes in text layout."""
    return _mot_rows(detections.filter("track_id IS NOT NULL"), F.col("track_id"))


def mot_det_rows(detections: DataFrame) -> DataFrame:
    """All boxes in text layout, id -1."""
    return _mot_rows(detections, F.lit(-1).cast("bigint"))


def write_mot(rows: DataFrame, path: str) -> None:
    """One folder per sequence, sorted by (frame, id) across its files.

    Range partitioning spreads a long sequence over files whose names follow the order.
    """
    ordered = rows.repartitionByRange("sequence_id", "frame", "id").sortWithinPartitions("sequence_id", "frame", "id")
    ordered.write.partitionBy("sequence_id").mode("errorifexists").csv(path)


#: Parts that the boxes of one sequence are dealt to.
SEQUENCE_PARTS = 128


def annotation_source(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Per sequence the truth boxes if there are any, else the predictions.

    A sequence may hold any share of the predictions: its boxes are dealt to parts, and the one row of a
    sequence with truth is there for each part.
    """
    parts = F.sequence(F.lit(0), F.lit(SEQUENCE_PARTS - 1))
    with_truth = gt.select("sequence_id").distinct().withColumn("_part", F.explode(parts))
    dealt = pred.withColumn("_part", F.pmod(F.xxhash64("frame", "id"), F.lit(SEQUENCE_PARTS)).cast("int"))
    kept = dealt.join(with_truth, ["sequence_id", "_part"], "left_anti")
    return gt.unionByName(kept.select(*pred.columns))


def sequence_summary(detections: DataFrame, fps: int, width: int, height: int) -> DataFrame:
    """Frames, unique tracks and entries of each exported sequence."""
    # Track ids are grouped first: a distinct count in the same aggregate would multiply rows.
    per_track = detections.groupBy("camera_id", "session_id", "track_id").agg(
        F.max("frame_number").alias("last"), F.count("*").alias("n")
    )
    tracked = F.col("track_id").isNotNull()
    return per_track.groupBy(F.concat_ws("_", "camera_id", "session_id").alias("sequence_id")).agg(
        F.max("last").alias("seq_length"),
        F.count_if(tracked).alias("unique_tracks"),
        F.sum(F.when(tracked, F.col("n")).otherwise(0)).alias("prediction_entries"),
        F.sum("n").alias("detection_entries"),
        F.lit(fps).alias("frame_rate"),
        F.lit(width).alias("im_width"),
        F.lit(height).alias("im_height"),
    )


# The section and fields of the description text that goes with a sequence.
INFO_SECTION = "[Sequence]"
INFO_FIELDS = ("name", "imDir", "frameRate", "seqLength", "imWidth", "imHeight", "imExt")


def write_sequence_info(summary: DataFrame, path: str, image_dir: str = "img1", image_ext: str = ".jpg") -> None:
    """The description text of each sequence, in the sequence's folder beside :func:`write_mot`'s."""
    values = ("sequence_id", F.lit(image_dir), "frame_rate", "seq_length", "im_width", "im_height", F.lit(image_ext))
    lines = [F.concat(F.lit(f"{field}="), value if not isinstance(value, str) else F.col(value).cast("string")) for field, value in zip(INFO_FIELDS, values, strict=True)]
    text = F.concat_ws("\n", F.lit(INFO_SECTION), *lines)
    summary.select("sequence_id", text.alias("value")).write.partitionBy("sequence_id").mode("errorifexists").text(path)


def read_sequence_info(spark: SparkSession, path: str) -> DataFrame:
    """``(sequence_id, name, im_dir, frame_rate, seq_length, im_width, im_height, im_ext)``; a field that is missing is null.

    Lines of other sections and without a value are skipped, names are compared without case.
    """
    texts = spark.read.schema("value string, sequence_id string").text(path, wholetext=True)
    section = F.regexp_extract("value", r"(?is)\[sequence\]([^\[]*)", 1)
    lines = F.filter(F.split(section, r"\r?\n"), lambda line: F.contains(line, F.lit("=")))
    pair = lambda line: F.struct(F.lower(F.trim(F.substring_index(line, "=", 1))), F.trim(F.regexp_replace(line, "^[^=]*=", "")))
    rows = texts.withColumn("m", F.map_from_entries(F.transform(lines, pair)))
    wanted = dict(zip(INFO_FIELDS, ("name", "im_dir", "frame_rate", "seq_length", "im_width", "im_height", "im_ext"), strict=True))
    whole = {"frame_rate": "int", "seq_length": "bigint", "im_width": "int", "im_height": "int"}
    return rows.select("sequence_id", *[F.col("m")[f.lower()].try_cast(whole.get(n, "string")).alias(n) for f, n in wanted.items()])


def new_box_filter(drawn: DataFrame, existing: DataFrame, min_side: float = 10) -> DataFrame:
    """Drawn boxes larger than the limit, with new ids above the sequence's largest id.

    ``drawn(sequence_id, draw_no, frame, bb_left, bb_top, bb_w, bb_h)``.
    """
    kept = drawn.filter((F.col("bb_w") > min_side) & (F.col("bb_h") > min_side))
    numbered = dense_number(kept, ["sequence_id"], "draw_no", "_no")
    top = existing.groupBy("sequence_id").agg(F.max("id").alias("top"))
    fresh = F.coalesce("top", F.lit(0)) + F.col("_no")
    return numbered.join(top, "sequence_id", "left").select(
        "sequence_id",
        "frame",
        fresh.alias("id"),
        "bb_left",
        "bb_top",
        "bb_w",
        "bb_h",
        F.lit(1.0).alias("conf"),
        F.lit(1).alias("class_id"),
    )


def propagate_boxes(boxes: DataFrame, selected: DataFrame, n_frames: int, last_frame: DataFrame) -> DataFrame:
    """Copy selected boxes to the next frames of their sequence.

    Not past the last frame and not where the track has a box already; if two selected boxes
    of a track reach the same frame, the earlier one is copied.
    """
    target = F.explode(F.sequence(F.col("frame") + 1, F.least(F.col("frame") + n_frames, F.col("last_frame"))))
    copies = (
        selected.join(last_frame, "sequence_id")
        .filter(F.col("frame") < F.col("last_frame"))
        .withColumn("target", target)
    )
    payload = [c for c in MOT_FIELDS if c not in ("frame", "id")]
    first = copies.groupBy("sequence_id", F.col("target").alias("frame"), "id").agg(
        F.min_by(F.struct(*payload), F.col("frame")).alias("b")
    )
    new = first.join(boxes.select("sequence_id", "frame", "id"), ["sequence_id", "frame", "id"], "left_anti")
    return boxes.select(*BOX_COLUMNS).unionByName(new.select("sequence_id", "frame", "id", "b.*"))
