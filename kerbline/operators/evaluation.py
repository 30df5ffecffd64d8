"""Tracking quality: per-frame matching of truth and predictions, and its metrics.

Relations are ``(sequence_id, frame, id, bb_left, bb_top, bb_w, bb_h, ...)``; an id occurs
once per frame. ``keys`` names the evaluation unit, by default the sequence.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.functions import geometry as g
from kerbline.operators.assign import solve_edges
from kerbline.operators.graph import connected_components
from kerbline.operators.ordered import CHUNK, previous
from kerbline.params import MATCH_IOU
from kerbline.session import cut_lineage

SEQ = ("sequence_id",)
FRAMES_PER_GROUP = 256


def _corners(df: DataFrame, keys, prefix: str) -> DataFrame:
    x1, y1, x2, y2 = g.from_ltwh(F.col("bb_left"), F.col("bb_top"), F.col("bb_w"), F.col("bb_h"))
    return df.select(
        *keys,
        "frame",
        F.col("id").alias(prefix + "id"),
        x1.alias(prefix + "x1"),
        y1.alias(prefix + "y1"),
        x2.alias(prefix + "x2"),
        y2.alias(prefix + "y2"),
    )


def iou_pairs(gt: DataFrame, pred: DataFrame, keys: Sequence[str] = SEQ) -> DataFrame:
    """IoU of every overlapping truth x prediction pair of a frame."""
    a, b = g.box("gt_"), g.box("pred_")
    return (
        _corners(gt, keys, "gt_")
        .join(_corners(pred, keys, "pred_"), [*keys, "frame"])
        .filter(g.overlaps(a, b))
        .select(*keys, "frame", "gt_id", "pred_id", g.iou(a, b).alias("iou"))
        .filter("iou > 0")
    )


def iou_pairs_gated(
    gt: DataFrame, pred: DataFrame, threshold: float = MATCH_IOU, keys: Sequence[str] = SEQ
) -> DataFrame:
    """Pairs within the distance gate ``1 - IoU <= 1 - threshold``."""
    distance = 1 - F.col("iou")
    return iou_pairs(gt, pred, keys).filter(distance <= 1 - threshold).withColumn("distance", distance)


def _solve_frames(keys: Sequence[str]):
    columns = [*keys, "frame", "gt_id", "pred_id", "iou"]

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        # A box is its frame and its id, so the frames of a block are one edge list whose components stay inside frames.
        group = group.sort_values(["frame", "gt_id", "pred_id"])
        _, frame = np.unique(group["frame"].to_numpy(), return_inverse=True)
        ends = []
        for side in ("gt_id", "pred_id"):
            ids, code = np.unique(group[side].to_numpy(), return_inverse=True)
            ends.append(frame * len(ids) + code)
        return group.loc[solve_edges(*ends, group["iou"].to_numpy()), columns]

    return solve


def frame_assignment(
    gt: DataFrame, pred: DataFrame, threshold: float = MATCH_IOU, keys: Sequence[str] = SEQ
) -> DataFrame:
    """Optimal one-to-one match per frame, then the IoU threshold.

    A pair that is the only overlap of both its boxes belongs to every optimal matching and
    stays in the JVM. Only the frames' other pairs go to Python, in groups of at most
    ``FRAMES_PER_GROUP`` frames. Pairs without overlap add nothing to a matching.
    """
    # One shuffle of the narrow pairs serves both windows and both branches below.
    pairs = iou_pairs(gt, pred, keys).repartition(*keys, "frame")
    degrees = pairs.withColumns(
        {
            "_g": F.count("*").over(W.partitionBy(*keys, "frame", "gt_id")),
            "_p": F.count("*").over(W.partitionBy(*keys, "frame", "pred_id")),
        }
    )
    isolated = (F.col("_g") == 1) & (F.col("_p") == 1)
    block = F.expr(f"frame div {FRAMES_PER_GROUP}")
    solved = (
        degrees.filter(~isolated)
        .drop("_g", "_p")
        .groupBy(*keys, block.alias("_block"))
        .applyInPandas(_solve_frames(keys), pairs.schema)
    )
    return degrees.filter(isolated).drop("_g", "_p").unionByName(solved).filter(F.col("iou") >= threshold)


def _tallies(gt: DataFrame, pred: DataFrame, matches: DataFrame, keys, extra=()) -> DataFrame:
    """Truth, prediction and match rows under one key, to be counted in one aggregation."""
    zero = {"is_gt": 0, "is_pred": 0, "is_match": 0}

    def tag(df, which, iou=None):
        flags = [F.lit(1 if f == which else 0).alias(f) for f in zero]
        return df.select(*keys, *extra, *flags, (iou if iou is not None else F.lit(None).cast("double")).alias("iou"))

    return (
        tag(gt, "is_gt").unionByName(tag(pred, "is_pred")).unionByName(tag(matches, "is_match", F.col("iou")))
    )


def match_outcomes(gt: DataFrame, pred: DataFrame, matches: DataFrame, keys: Sequence[str] = SEQ) -> DataFrame:
    """Matches, misses and false positives of each frame."""
    counts = (
        _tallies(gt, pred, matches, keys, ["frame"])
        .groupBy(*keys, "frame")
        .agg(
            F.sum("is_match").alias("tp"),
            F.sum("is_gt").alias("gt_count"),
            F.sum("is_pred").alias("pred_count"),
        )
    )
    return counts.select(
        *keys,
        "frame",
        "tp",
        (F.col("gt_count") - F.col("tp")).alias("fn"),
        (F.col("pred_count") - F.col("tp")).alias("fp"),
        "gt_count",
        "pred_count",
    )


def id_switches(matches: DataFrame, keys: Sequence[str] = SEQ, size: int = CHUNK) -> DataFrame:
    """Matches whose prediction id differs from the track's previous match, however long ago."""
    last = previous(
        matches.select(*keys, "gt_id", "frame", "pred_id"), [*keys, "gt_id"], "frame", {"prev_pred_id": "pred_id"}, size
    )
    return last.filter("prev_pred_id <> pred_id")


def _pct(numerator, denominator):
    return F.when(denominator > 0, 100.0 * numerator / denominator).otherwise(F.lit(0.0))


def clear_mot(gt: DataFrame, pred: DataFrame, matches: DataFrame, keys: Sequence[str] = SEQ) -> DataFrame:
    """CLEAR-MOT scores per evaluation unit, in percent; 0 where nothing can be divided.

    ``matches`` is read several times: hand in a written or cached relation.
    """
    counts = (
        _tallies(gt, pred, matches, keys)
        .groupBy(*keys)
        .agg(
            F.sum("is_match").alias("tp"),
            F.sum("is_gt").alias("gt_objects"),
            F.sum("is_pred").alias("predictions"),
            F.sum("iou").alias("iou_sum"),
        )
    )
    switches = id_switches(matches, keys).groupBy(*keys).agg(F.count("*").alias("id_switches"))
    tp, n_gt, n_pred = F.col("tp"), F.col("gt_objects"), F.col("predictions")
    fn, fp = n_gt - tp, n_pred - tp
    sw = F.coalesce("id_switches", F.lit(0))
    errors = F.when(n_gt > 0, (1.0 - (fn + fp + sw) / n_gt) * 100).otherwise(F.lit(0.0))
    recall, precision = F.round(_pct(tp, n_gt), 2), F.round(_pct(tp, n_pred), 2)
    return counts.join(switches, list(keys), "left").select(
        *keys,
        F.round(errors, 2).alias("mota"),
        F.round(_pct(F.col("iou_sum"), tp), 2).alias("motp"),
        F.round(_pct(2 * tp, n_gt + n_pred), 2).alias("idf1"),
        precision.alias("idp"),
        recall.alias("idr"),
        recall.alias("recall"),
        precision.alias("precision"),
        sw.alias("id_switches"),
        fp.alias("fp"),
        fn.alias("fn"),
        n_gt.alias("gt_objects"),
        n_pred.alias("predictions"),
    )


def track_coverage(gt: DataFrame, matches: DataFrame, keys: Sequence[str] = SEQ) -> DataFrame:
    """Mostly tracked, partially tracked and mostly lost truth tracks."""
    seen = gt.select(*keys, "id", F.lit(1).alias("is_gt"), F.lit(0).alias("is_match"))
    hit = matches.select(*keys, F.col("gt_id").alias("id"), F.lit(0).alias("is_gt"), F.lit(1).alias("is_match"))
    share = F.sum("is_match") / F.sum("is_gt")
    per_track = seen.unionByName(hit).groupBy(*keys, "id").agg(share.alias("share"))
    mt, ml = F.col("share") >= 0.8, F.col("share") <= 0.2
    return per_track.groupBy(*keys).agg(
        F.count("*").alias("tracks"),
        F.count_if(mt).alias("mt"),
        F.count_if(~mt & ~ml).alias("pt"),
        F.count_if(ml).alias("ml"),
    )


def class_breakdown(
    gt: DataFrame, pred: DataFrame, threshold: float = MATCH_IOU, classes: Sequence[int] | None = None
) -> DataFrame:
    """Scores per class: both sides are restricted to the class before matching."""
    keys = ("sequence_id", "class_id")
    if classes:
        gt = gt.filter(F.col("class_id").isin(list(classes)))
        pred = pred.filter(F.col("class_id").isin(list(classes)))
    return clear_mot(gt, pred, cut_lineage(frame_assignment(gt, pred, threshold, keys)), keys)


def fragmentations(gt: DataFrame, matches: DataFrame, keys: Sequence[str] = SEQ, size: int = CHUNK) -> DataFrame:
    """Interruptions of each truth track between its first and last match.

    Every run of matched frames after the first ends one interruption.
    """
    hit = matches.select(*keys, "frame", F.col("gt_id").alias("id"), F.lit(1).alias("m"))
    rows = gt.select(*keys, "frame", "id").join(hit, [*keys, "frame", "id"], "left")
    flagged = rows.withColumn("m", F.coalesce("m", F.lit(0)))
    steps = previous(flagged, [*keys, "id"], "frame", {"prev_m": "m"}, size)
    starts = F.count_if((F.col("m") == 1) & (F.coalesce("prev_m", F.lit(0)) == 0))
    per_track = steps.groupBy(*keys, "id").agg(F.greatest(starts - 1, F.lit(0)).alias("fragments"))
    return per_track.groupBy(*keys).agg(F.sum("fragments").alias("fragmentations"))


#: Rounds of taking dominant pairs; a longer chain of them is left to the solver.
DOMINANT_ROUNDS = 20


def dominant_pairs(overlaps: DataFrame, keys: Sequence[str] = SEQ) -> tuple[DataFrame | None, DataFrame]:
    """Pairs that belong to a best matching by their weight alone, and the pairs that are left.

    A pair that weighs as much as the heaviest other pair of its truth track and the heaviest other one of its prediction
    together can replace both in any matching. Taking it removes the pairs of its two tracks, which makes others dominant. Each round
    is grouped work of the whole table, so a large tangle is cut to small ones without one task holding it.
    """
    columns = [*keys, "gt_id", "pred_id", "frames"]
    taken, left = None, overlaps
    for _ in range(DOMINANT_ROUNDS):
        ranked = left
        for side, other in (("gt", "pred"), ("pred", "gt")):
            order = W.partitionBy(*keys, f"{side}_id").orderBy(F.desc("frames"), f"{other}_id")
            whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
            ranked = ranked.withColumns(
                {f"_{side}_no": F.row_number().over(order), f"_{side}_next": F.coalesce(F.nth_value("frames", 2).over(whole), F.lit(0))}
            )
        first = (F.col("_gt_no") == 1) & (F.col("_pred_no") == 1)
        chosen = cut_lineage(ranked.filter(first & (F.col("frames") >= F.col("_gt_next") + F.col("_pred_next"))).select(*columns))
        if chosen.isEmpty():
            break
        taken = chosen if taken is None else taken.unionByName(chosen)
        for side in ("gt_id", "pred_id"):
            left = left.join(chosen.select(*keys, side), [*keys, side], "left_anti")
        left = cut_lineage(left.select(*columns))
    return taken, left


def track_assignment(overlaps: DataFrame, keys: Sequence[str] = SEQ) -> DataFrame:
    """One-to-one match of truth tracks to predicted tracks with the most shared frames.

    ``overlaps(keys..., gt_id, pred_id, frames)`` is split by shape. A star, whose centre is
    the only partner of all its leaves, is decided by a maximum. Then dominant pairs are taken.
    What remains is cut into connected components, and each component is solved on its own.
    """
    gt_side, pred_side = W.partitionBy(*keys, "gt_id"), W.partitionBy(*keys, "pred_id")
    shaped = overlaps.withColumns({"_g": F.count("*").over(gt_side), "_p": F.count("*").over(pred_side)})
    shaped = shaped.withColumns({"_gp": F.max("_p").over(gt_side), "_pg": F.max("_g").over(pred_side)})
    gt_star, pred_star = F.col("_gp") == 1, (F.col("_pg") == 1) & (F.col("_gp") > 1)
    columns = [*keys, "gt_id", "pred_id", "frames"]
    pick_pred = F.max_by(F.struct("pred_id", "frames"), F.struct("frames", -F.col("pred_id")))
    pick_gt = F.max_by(F.struct("gt_id", "frames"), F.struct("frames", -F.col("gt_id")))
    by_gt = shaped.filter(gt_star).groupBy(*keys, "gt_id").agg(pick_pred.alias("b")).select(*keys, "gt_id", "b.*")
    by_pred = (
        shaped.filter(pred_star).groupBy(*keys, "pred_id").agg(pick_gt.alias("b")).select(*keys, "pred_id", "b.*")
    )
    easy = by_gt.select(*columns).unionByName(by_pred.select(*columns))
    rest = cut_lineage(shaped.filter(~gt_star & ~pred_star).select(*columns))
    if rest.isEmpty():
        return easy
    taken, rest = dominant_pairs(rest, keys)
    if taken is not None:
        easy = easy.unionByName(taken)
    if rest.isEmpty():
        return easy

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["gt_id", "pred_id"])
        mask = solve_edges(group["gt_id"].to_numpy(), group["pred_id"].to_numpy(), group["frames"].to_numpy(float))
        return group.loc[mask, columns]

    node = lambda side, column: F.concat_ws("|", F.lit(side), *keys, column)
    edges = rest.withColumns({"a": node("g", "gt_id"), "b": node("p", "pred_id")})
    labels = connected_components(edges.select("a", "b"))
    hard = (
        edges.join(labels.withColumnRenamed("node", "a"), "a")
        .groupBy("component")
        .applyInPandas(solve, rest.schema)
    )
    return easy.unionByName(hard)


def global_idf1(
    gt: DataFrame, pred: DataFrame, threshold: float = MATCH_IOU, keys: Sequence[str] = SEQ
) -> DataFrame:
    """Identity scores from one assignment of whole tracks per evaluation unit."""
    shared = (
        iou_pairs_gated(gt, pred, threshold, keys)
        .groupBy(*keys, "gt_id", "pred_id")
        .agg(F.count("*").alias("frames"))
    )
    shared = cut_lineage(shared)
    idtp = track_assignment(shared, keys).groupBy(*keys).agg(F.sum("frames").alias("idtp"))
    none = gt.limit(0).select(*keys, F.lit(0.0).alias("iou"))
    totals = (
        _tallies(gt, pred, none, keys)
        .groupBy(*keys)
        .agg(F.sum("is_gt").alias("gt_objects"), F.sum("is_pred").alias("predictions"))
    )
    tp = F.coalesce("idtp", F.lit(0))
    return totals.join(idtp, list(keys), "left").select(
        *keys,
        tp.alias("idtp"),
        F.round(_pct(2 * tp, F.col("gt_objects") + F.col("predictions")), 2).alias("idf1"),
        F.round(_pct(tp, F.col("predictions")), 2).alias("idp"),
        F.round(_pct(tp, F.col("gt_objects")), 2).alias("idr"),
    )


# Metric names of the report, from our columns.
METRIC_NAMES = {
    "mota": "MOTA",
    "motp": "MOTP",
    "idf1": "IDF1",
    "idp": "IDP",
    "idr": "IDR",
    "recall": "Recall",
    "precision": "Precision",
    "id_switches": "ID_Switches",
    "fp": "FP",
    "fn": "FN",
    "gt_objects": "GT_Objects",
    "predictions": "Predictions",
    "mt": "MT",
    "ml": "ML",
    "pt": "PT",
    "frag": "Frag",
    "frames": "Frames",
    "iou_threshold": "IoU_Threshold",
}


def metrics_long(
    gt: DataFrame, pred: DataFrame, threshold: float = MATCH_IOU, keys: Sequence[str] = SEQ
) -> DataFrame:
    """All scores as ``(keys..., metric, value)``. Fragmentation is not part of this report: 0."""
    matches = cut_lineage(frame_assignment(gt, pred, threshold, keys))
    both = gt.select(*keys, "frame").unionByName(pred.select(*keys, "frame"))
    n_frames = both.distinct().groupBy(*keys).agg(F.count("*").alias("frames"))
    wide = (
        clear_mot(gt, pred, matches, keys)
        .join(track_coverage(gt, matches, keys), list(keys), "left")
        .join(n_frames, list(keys))
        .withColumns({"frag": F.lit(0), "iou_threshold": F.lit(threshold)})
    )
    named = wide.select(
        *keys, *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(n) for c, n in METRIC_NAMES.items()]
    )
    return named.unpivot(list(keys), list(METRIC_NAMES.values()), "metric", "value")


def eval_input_check(gt: DataFrame, pred: DataFrame, keys: Sequence[str] = SEQ) -> DataFrame:
    """Frames and boxes of each side; a sequence with an empty side has no metrics."""
    sides = gt.select(*keys, "frame", F.lit(1).alias("g")).unionByName(
        pred.select(*keys, "frame", F.lit(0).alias("g"))
    )
    per_frame = sides.groupBy(*keys, "frame").agg(F.sum("g").alias("g"), F.sum(1 - F.col("g")).alias("p"))
    totals = per_frame.groupBy(*keys).agg(
        F.count_if(F.col("g") > 0).alias("gt_frames"),
        F.sum("g").alias("gt_boxes"),
        F.count_if(F.col("p") > 0).alias("pred_frames"),
        F.sum("p").alias("pred_boxes"),
    )
    status = (
        F.when(F.col("gt_boxes") == 0, "no ground truth").when(F.col("pred_boxes") == 0, "no predictions").otherwise("ok")
    )
    return totals.withColumn("status", status)
