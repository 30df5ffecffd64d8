"""Temporal confirmation of violations and per-track windows.

Time is counted in *ticks*, the non-empty frames of a camera session. For one track a
trigger-class row is a *hit* when it rides and *frozen* when it does not; every other tick
is a miss. Frozen ticks stop the clock: with ``clock = tick - frozen rows so far`` two hits
belong to the same streak exactly when their clocks differ by at most ``patience + 1``.

All windows run inside chunks of ticks (see :mod:`kerbline.operators.ordered`), so a track
of any length is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.functions.geometry import ioa
from kerbline.functions.labels import violation_type
from kerbline.operators.detections import BOX, FRAME, with_best_ioa
from kerbline.operators.ordered import (
    CHUNK,
    CHUNK_COL,
    before,
    chunk_of,
    dense_number,
    following,
    inside,
    previous,
    running_sum,
    with_halo,
)
from kerbline.params import DISPLAY_IOA, MOTORCYCLE, RIDER_CLASSES, Confirmation, max_time_lost
from kerbline.session import cut_lineage

SESSION = ("camera_id", "session_id")
TRACK = (*SESSION, "track_id")
RULE = Confirmation()


def frame_ticks(detections: DataFrame, size: int = CHUNK) -> DataFrame:
    """Number of each frame among the non-empty frames of its camera session."""
    return dense_number(detections.select(*FRAME).distinct(), SESSION, "frame_number", "tick", size)


def _track_rows(detections: DataFrame, rule: Confirmation, classes: Sequence[int], size: int) -> DataFrame:
    """Tracked rider rows with tick and kind: hit, frozen or other."""
    columns = [*FRAME, "det_idx", "track_id", "class_id", "confidence", *BOX]
    riders = detections.filter(F.col("class_id").isin(list(classes)) & F.col("track_id").isNotNull())
    trigger = F.col("class_id") == rule.trigger_class
    rides = F.col("best_ioa") >= rule.ioa
    return (
        with_best_ioa(detections, riders.select(*columns))
        .join(frame_ticks(detections, size), list(FRAME))
        .withColumns({"hit": trigger & rides, "frozen": trigger & ~rides})
    )


def streaks(rows: DataFrame, patience: int, size: int = CHUNK) -> DataFrame:
    """Streak state of each row as of its own tick.

    Adds ``hit_no`` (hits of the track so far), ``streak_start`` (``hit_no`` of the first hit
    of the current streak), ``position`` in that streak, ``misses`` before a hit, and
    ``streak``, the position or 0 once patience is used up.
    """
    reach = patience + 1
    upto = inside(TRACK, "tick").rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = inside(TRACK, "tick").rowsBetween(W.unboundedPreceding, -1)
    hit, e = F.col("hit"), F.col("_e")

    # Inside a chunk, as if nothing had come before it.
    local = (
        rows.withColumn(CHUNK_COL, chunk_of(F.col("tick"), size))
        .withColumn("_e", F.col("tick") - F.sum(F.col("frozen").cast("bigint")).over(upto))
        .withColumns(
            {
                "_hits": F.sum(hit.cast("bigint")).over(upto),
                "_prev": F.last(F.when(hit, e), ignorenulls=True).over(earlier),
            }
        )
        .withColumn("_break", F.max(F.when(hit & (e - F.col("_prev") > reach), F.col("_hits"))).over(upto))
    )

    # One row per chunk, then what earlier chunks carry in.
    over = before(TRACK)
    state = (
        local.groupBy(*TRACK, CHUNK_COL)
        .agg(
            F.count_if("frozen").alias("fz"),
            F.count_if("hit").alias("n"),
            F.min(F.when(hit, e)).alias("first_e"),
            F.max(F.when(hit, e)).alias("last_e"),
            F.max("_break").alias("tail_break"),
        )
        .withColumns(
            {
                "f_in": F.coalesce(F.sum("fz").over(over), F.lit(0)),
                "h_in": F.coalesce(F.sum("n").over(over), F.lit(0)),
            }
        )
        .withColumn("clock_in", F.last(F.col("last_e") - F.col("f_in"), ignorenulls=True).over(over))
        .withColumn(
            "linked",
            F.coalesce(F.col("first_e") - F.col("f_in") - F.col("clock_in") <= reach, F.lit(False)),
        )
        .withColumn(
            "_start",
            F.when(
                (F.col("n") > 0) & (F.col("tail_break").isNotNull() | ~F.col("linked")),
                F.col("h_in") + F.coalesce("tail_break", F.lit(1)),
            ),
        )
        .withColumn("start_in", F.last("_start", ignorenulls=True).over(over))
        .select(*TRACK, CHUNK_COL, "f_in", "h_in", "clock_in", "linked", "start_in")
    )

    clock = e - F.col("f_in")
    prev_clock = F.coalesce(F.col("_prev") - F.col("f_in"), F.col("clock_in"))
    start = (
        F.when(F.col("_break").isNotNull(), F.col("h_in") + F.col("_break"))
        .when((F.col("_hits") > 0) & ~F.col("linked"), F.col("h_in") + 1)
        .otherwise(F.col("start_in"))
    )
    idle = F.when(hit, F.lit(0)).otherwise(clock - prev_clock)
    return (
        local.join(state, [*TRACK, CHUNK_COL])
        .withColumns(
            {
                "hit_no": F.col("h_in") + F.col("_hits"),
                "streak_start": start,
                "misses": F.when(hit, clock - prev_clock - 1),
                "_alive": F.coalesce(idle <= patience, F.lit(False)),
            }
        )
        .withColumn("position", F.col("hit_no") - F.col("streak_start") + 1)
        .withColumn("streak", F.when(F.col("_alive"), F.col("position")).otherwise(F.lit(0)))
        .select(*rows.columns, "hit_no", "streak_start", "position", "misses", "streak")
    )


def streak_state(detections: DataFrame, rule: Confirmation = RULE, size: int = CHUNK) -> DataFrame:
    """Trigger rows with their kind, the streak as of the row and the misses before a hit."""
    rows = _track_rows(detections, rule, [rule.trigger_class], size)
    return streaks(rows, rule.patience, size).select(
        *FRAME,
        "track_id",
        "det_idx",
        F.when(F.col("hit"), "hit").otherwise("frozen").alias("kind"),
        "streak",
        "misses",
    )


def _confirmed(hits: DataFrame, keys: Sequence[str], frames) -> DataFrame:
    """First streak of each key that reaches ``frames`` hits, with mean confidence and box.

    Two hash aggregations (per streak, per track) with map-side combine; no window.
    """
    frames = F.lit(frames) if isinstance(frames, int) else frames
    position = F.col("position")
    at = F.struct("frame_number", "det_idx", "class_id", *BOX)
    per_streak = (
        hits.filter(position <= frames)
        .groupBy(*keys, "streak_start")
        .agg(F.avg("confidence").alias("mean_confidence"), F.max(F.when(position == frames, at)).alias("at"))
        .filter("at IS NOT NULL")
    )
    first = per_streak.groupBy(*keys).agg(
        F.min_by(F.struct("at", "mean_confidence"), F.col("at.frame_number")).alias("f")
    )
    return first.select(*keys, "f.at.*", F.col("f.mean_confidence").alias("confidence"))


def _chunk_summaries(detections: DataFrame, rule: Confirmation, most: int, size: int) -> DataFrame:
    """One row per track and chunk of frames: what it does to a streak that comes in. Written.

    The rows of a chunk meet in one exchange; frames, local ticks, riding and segments (hits without a break
    inside the chunk) all follow on that distribution. ``head`` is the segment that may go on with a streak from before,
    ``tail`` the last one, ``inner`` the first ``N``-th hit of a later segment for each ``N`` up to ``most``. Rows
    of no track keep the number of frames of their chunk.
    """
    chunk = [*SESSION, CHUNK_COL]
    box = F.struct(*BOX)
    rider = F.struct("track_id", "det_idx", "class_id", "confidence", *BOX)
    is_rider = (F.col("class_id") == rule.trigger_class) & F.col("track_id").isNotNull()
    frames = (
        detections.select(*FRAME, "det_idx", "track_id", "class_id", "confidence", *BOX)
        .withColumn(CHUNK_COL, chunk_of(F.col("frame_number"), size))
        .repartition(*chunk)
        .groupBy(*chunk, "frame_number")
        .agg(
            F.collect_list(F.when(F.col("class_id") == MOTORCYCLE, box)).alias("motorcycles"),
            F.collect_list(F.when(is_rider, rider)).alias("riders"),
        )
        .withColumn("tick", F.row_number().over(W.partitionBy(*chunk).orderBy("frame_number")))
    )
    corners = lambda b: tuple(b[c] for c in BOX)
    rides = lambda r: F.exists("motorcycles", lambda m: ioa(corners(r), corners(m)) >= rule.ioa)
    marked = F.transform("riders", lambda r: F.struct(r.alias("r"), rides(r).alias("hit")))
    rows = frames.select(*chunk, "frame_number", "tick", F.explode_outer(marked).alias("m")).select(
        *chunk, "frame_number", "tick", F.col("m.r.track_id").alias("track_id"), F.col("m.hit").alias("hit"), F.col("m.r").alias("r")
    )
    upto = inside(TRACK, "tick").rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = inside(TRACK, "tick").rowsBetween(W.unboundedPreceding, -1)
    hit, e = F.col("hit"), F.col("_e")
    local = (
        rows.withColumn("_e", F.col("tick") - F.sum((~hit).cast("bigint")).over(upto))
        .withColumns({"_hits": F.sum(hit.cast("bigint")).over(upto), "_prev": F.last(F.when(hit, e), ignorenulls=True).over(earlier)})
        .withColumn("_break", F.max(F.when(hit & (e - F.col("_prev") > rule.patience + 1), F.col("_hits"))).over(upto))
        .withColumn("segment", F.coalesce("_break", F.lit(0)))
        .withColumn("position", F.col("_hits") - F.coalesce("_break", F.lit(1)) + 1)
    )
    at = F.struct(F.col("frame_number"), F.col("r.det_idx").alias("det_idx"), F.col("r.class_id").alias("class_id"), *[F.col(f"r.{c}").alias(c) for c in BOX])
    entry = F.struct("position", F.col("r.confidence").alias("confidence"), at.alias("at"))
    by_segment = local.groupBy(*TRACK, CHUNK_COL, "segment").agg(
        F.count_if(hit).alias("n"),
        F.count_if(~hit).alias("frozen"),
        F.max("tick").alias("frames"),
        F.min(F.when(hit, e)).alias("first"),
        F.max(F.when(hit, e)).alias("last"),
        F.sort_array(F.collect_list(F.when(hit & (F.col("position") <= most), entry))).alias("hits"),
    )
    whole = F.struct("segment", "n", "first", "last", "hits")
    nth = [F.min(F.when((F.col("segment") > 0) & (F.col("n") >= k), F.struct("segment", "hits"))).alias(f"_{k}") for k in range(1, most + 1)]
    summary = by_segment.groupBy(*TRACK, CHUNK_COL).agg(
        F.sum("frozen").alias("frozen"),
        F.max("frames").alias("frames"),
        F.max(F.when((F.col("segment") == 0) & (F.col("n") > 0), whole)).alias("head"),
        F.max(F.when(F.col("n") > 0, whole)).alias("tail"),
        *nth,
    )
    inner = F.array(*[F.when(F.col(f"_{k}").isNotNull(), F.slice(f"_{k}.hits", 1, k)) for k in range(1, most + 1)])
    return cut_lineage(summary.withColumn("inner", inner).drop(*[f"_{k}" for k in range(1, most + 1)]))


def _first_confirmed(detections: DataFrame, rule: Confirmation, thresholds: Sequence[int], size: int) -> DataFrame:
    """``(track, frames, frame_number, det_idx, class_id, box, confidence)``: the first confirmation of each track for every
    threshold ``frames``; null where it has hits but no confirmation.

    The summaries of a track are composed in the order of its chunks: a running sum that is read from the last break gives the
    hits (and confidences) that come in, and a confirmation lies in the head, completed by those, or inside.
    """
    most = max(thresholds)
    found = _chunk_summaries(detections, rule, most, size)
    # Ticks before a chunk: a row per chunk and session.
    per_chunk = found.groupBy(*SESSION, CHUNK_COL).agg(F.max("frames").alias("frames"))
    offsets = per_chunk.select(*SESSION, CHUNK_COL, F.coalesce(F.sum("frames").over(before(SESSION)), F.lit(0)).alias("offset"))
    rows = found.filter("track_id IS NOT NULL").join(offsets, [*SESSION, CHUNK_COL])

    over = before(TRACK)
    upto = W.partitionBy(*TRACK).orderBy(CHUNK_COL).rowsBetween(W.unboundedPreceding, W.currentRow)
    total = lambda hits: F.aggregate(hits, F.lit(0.0), lambda s, h: s + h["confidence"])
    has = F.col("tail").isNotNull()
    # The head is the tail where the chunk has no break.
    rows = (
        rows.withColumn("base", F.col("offset") - F.coalesce(F.sum("frozen").over(over), F.lit(0)))
        .withColumn("clock_in", F.last(F.col("base") + F.col("tail.last"), ignorenulls=True).over(over))
        .withColumn("linked", F.coalesce(F.col("base") + F.col("head.first") - F.col("clock_in") <= rule.patience + 1, F.lit(False)))
        .withColumns({"own": F.coalesce("tail.n", F.lit(0)), "own_sum": F.coalesce(total(F.col("tail.hits")), F.lit(0.0))})
        .withColumns({"all": F.sum("own").over(upto), "all_sum": F.sum("own_sum").over(upto)})
    )
    fresh = has & ((F.col("tail.segment") > 0) | ~F.col("linked"))
    since = F.last(F.when(fresh, F.struct((F.col("all") - F.col("own")).alias("n"), (F.col("all_sum") - F.col("own_sum")).alias("sum"))), ignorenulls=True)
    carried = rows.withColumn("since", since.over(over))
    length = F.when(F.col("linked"), F.col("all") - F.col("own") - F.col("since.n")).otherwise(F.lit(0))
    carried = carried.withColumns(
        {"length": length, "length_sum": F.when(F.col("linked"), F.col("all_sum") - F.col("own_sum") - F.col("since.sum")).otherwise(F.lit(0.0))}
    )
    each = carried.select(*TRACK, "head", "inner", "length", "length_sum", F.explode(F.array(*map(F.lit, thresholds))).alias("frames")).withColumn(
        "left", F.col("frames") - F.col("length")
    )
    within = F.slice("head.hits", 1, F.greatest("left", F.lit(1)))
    in_head = F.when(
        (F.col("left") > 0) & (F.col("head.n") >= F.col("left")),
        F.struct(F.get(within, F.col("left").cast("int") - 1)["at"].alias("at"), ((F.col("length_sum") + total(within)) / F.col("frames")).alias("confidence")),
    )
    inside_ = F.get("inner", F.col("frames") - 1)
    later = F.when(
        inside_.isNotNull(), F.struct(F.get(inside_, F.col("frames") - 1)["at"].alias("at"), (total(inside_) / F.col("frames")).alias("confidence"))
    )
    each = each.withColumn("f", F.coalesce(in_head, later)).filter("head IS NOT NULL")
    first = each.groupBy(*TRACK, "frames").agg(F.min_by("f", F.col("f.at.frame_number")).alias("f"))
    return first.select(*TRACK, "frames", "f.at.*", "f.confidence")


def confirmed_violations(detections: DataFrame, rule: Confirmation = RULE, size: int = CHUNK) -> DataFrame:
    """One event per track at the hit that completes N hits of a streak."""
    found = _first_confirmed(detections, rule, [rule.frames], size).filter("frame_number IS NOT NULL")
    return found.select(
        F.md5(F.concat_ws("|", *TRACK)).alias("event_id"),
        *TRACK,
        "frame_number",
        violation_type(F.col("class_id")).alias("violation_type"),
        "confidence",
        *[F.col(c).cast("int").alias(f"bbox_{c}") for c in BOX],
    )


def confirmation_sweep(
    detections: DataFrame, thresholds: Sequence[int] = (1, 3, 5), rule: Confirmation = RULE, size: int = CHUNK
) -> DataFrame:
    """Confirmations for several N from one computation of the streaks."""
    found = _first_confirmed(detections, rule, thresholds, size).filter("frame_number IS NOT NULL")
    counts = found.groupBy(F.col("frames").alias("confirm_frames")).agg(
        F.count("*").alias("violations"), F.avg("confidence").alias("mean")
    )
    listed = detections.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in thresholds])).alias("confirm_frames"))
    return listed.join(counts, "confirm_frames", "left").select(
        "confirm_frames",
        F.coalesce("violations", F.lit(0)).alias("total_violations"),
        F.coalesce(F.round("mean", 3), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce("violations", F.lit(0)).alias("unique_tracks"),
    )


def confirmation_stats(detections: DataFrame, rule: Confirmation = RULE, size: int = CHUNK) -> DataFrame:
    """Violated tracks and tracks that ever had a hit. The ids are the rows of D3's result."""
    return _first_confirmed(detections, rule, [rule.frames], size).agg(
        F.count("frame_number").alias("total_violations"),
        F.count("*").alias("streak_tracks"),
    )


def violation_summary(confirmed: DataFrame) -> DataFrame:
    """Confirmed count and mean confidence, 0 when there is none."""
    return confirmed.agg(
        F.count("*").alias("total_confirmed"),
        F.coalesce(F.round(F.avg("confidence"), 3), F.lit(0.0)).alias("avg_confidence"),
    )


def _rider_view(detections: DataFrame, rule: Confirmation, size: int) -> DataFrame:
    """Tracked rider rows with streak as of the frame and whether already violated."""
    rows = cut_lineage(streaks(_track_rows(detections, rule, RIDER_CLASSES, size), rule.patience, size))
    done = _confirmed(rows.filter("hit"), TRACK, rule.frames).select(
        *TRACK, F.col("frame_number").alias("confirmed_at")
    )
    violated = F.coalesce(F.col("confirmed_at") <= F.col("frame_number"), F.lit(False))
    return rows.join(done, list(TRACK), "left").withColumn("violated", violated)


def detection_status(
    detections: DataFrame, rule: Confirmation = RULE, display_ioa: float = DISPLAY_IOA, size: int = CHUNK
) -> DataFrame:
    """Display label of each box; the first matching rule wins."""
    near = F.col("best_ioa") >= display_ioa
    key = [*FRAME, "det_idx", "track_id", "class_id"]
    riders = _rider_view(detections, rule, size).select(*key, "best_ioa", "streak", "violated")
    untracked = detections.filter(
        F.col("track_id").isNull() & F.col("class_id").isin(list(RIDER_CLASSES))
    ).select(*key, *BOX)
    loose = with_best_ioa(detections, untracked).select(
        *key, "best_ioa", F.lit(0).cast("bigint").alias("streak"), F.lit(False).alias("violated")
    )
    rest = detections.filter(~F.col("class_id").isin(list(RIDER_CLASSES))).select(
        *key, F.lit(0.0).alias("best_ioa"), F.lit(0).cast("bigint").alias("streak"), F.lit(False).alias("violated")
    )
    label = (
        F.when(F.col("class_id") == MOTORCYCLE, "MOTOR")
        .when(F.col("violated"), "VIOLATED")
        .when((F.col("streak") > 0) & near, F.format_string(f"STREAK %d/{rule.frames}", "streak"))
        .when(F.col("class_id").isin(list(RIDER_CLASSES)) & ~near, "NO MOTOR")
        .when(F.col("class_id") == 0, "SAFE")
        .otherwise("WATCH")
    )
    return riders.unionByName(loose).unionByName(rest).select(*key, label.alias("status"))


def streak_progress(
    detections: DataFrame, rule: Confirmation = RULE, display_ioa: float = DISPLAY_IOA, size: int = CHUNK
) -> DataFrame:
    """Progress ``min(streak / N, 1)`` of riding, not yet confirmed riders with a streak."""
    rows = _rider_view(detections, rule, size)
    open_ = rows.filter((F.col("streak") > 0) & ~F.col("violated") & (F.col("best_ioa") >= display_ioa))
    return open_.select(
        *FRAME, "track_id", "det_idx", "streak", F.least(F.col("streak") / rule.frames, F.lit(1.0)).alias("progress")
    )


def track_trails(detections: DataFrame, length: int = 60, size: int = 4096) -> DataFrame:
    """Last ``length`` integer centres of each track, in frame order, at every sighting."""
    tracked = detections.filter("track_id IS NOT NULL").select(
        *FRAME,
        "track_id",
        F.expr("(int(x1) + int(x2)) div 2").alias("cx"),
        F.expr("(int(y1) + int(y2)) div 2").alias("cy"),
    )
    haloed = with_halo(tracked, TRACK, "frame_number", length - 1, size)
    recent = inside(TRACK, "frame_number").rowsBetween(-(length - 1), W.currentRow)
    trail = F.collect_list(F.struct("cx", "cy")).over(recent)
    return haloed.withColumn("trail", trail).filter("NOT _halo").select(*FRAME, "track_id", "trail")


def _sightings(detections: DataFrame) -> DataFrame:
    # Hardly a row repeats, so a map-side combine would only hold what a scan task reads; after the exchange a task has a bounded part.
    return detections.filter("track_id IS NOT NULL").select(*TRACK, "frame_number").repartition(*TRACK, "frame_number").distinct()


def track_lifecycle(detections: DataFrame, max_lost: int | None = None, size: int = CHUNK) -> DataFrame:
    """Per track: first and last frame, age, gaps, remaining lifetime and state at the end."""
    max_lost = max_time_lost() if max_lost is None else max_lost
    seen = previous(_sightings(detections), TRACK, "frame_number", {"prev_frame": "frame_number"}, size)
    gap = F.col("frame_number") - F.col("prev_frame") - 1
    per_track = seen.groupBy(*TRACK).agg(
        F.min("frame_number").alias("first_frame"),
        F.max("frame_number").alias("last_frame"),
        F.count("*").alias("frames_seen"),
        F.count_if(gap > 0).alias("lost_spans"),
        F.coalesce(F.sum(gap), F.lit(0)).alias("lost_frames"),
        F.coalesce(F.max(gap), F.lit(0)).alias("longest_gap"),
    )
    session = detections.groupBy(*SESSION).agg(F.max("frame_number").alias("session_last"))
    lost_for = F.col("session_last") - F.col("last_frame")
    return per_track.join(session, list(SESSION)).select(
        *TRACK,
        "first_frame",
        "last_frame",
        (F.col("last_frame") - F.col("first_frame")).alias("age"),
        "frames_seen",
        "lost_spans",
        "lost_frames",
        "longest_gap",
        F.greatest(F.lit(0), max_lost - lost_for).alias("remaining_ttl"),
        F.when(lost_for == 0, "active").when(lost_for <= max_lost, "lost").otherwise("removed").alias("state"),
    )


def reid_events(detections: DataFrame, max_lost: int | None = None, size: int = CHUNK) -> DataFrame:
    """Sightings of a track that was lost, and not yet removed, in the frame before."""
    max_lost = max_time_lost() if max_lost is None else max_lost
    seen = previous(_sightings(detections), TRACK, "frame_number", {"prev_frame": "frame_number"}, size)
    lost = F.col("frame_number") - F.col("prev_frame") - 1
    return seen.withColumn("frames_lost", lost).filter((lost >= 1) & (lost <= max_lost))


def track_state_counts(
    detections: DataFrame, frames: DataFrame, max_lost: int | None = None, size: int = CHUNK
) -> DataFrame:
    """Active, lost and removed tracks of every frame.

    A track changes state at few frames, so only those changes are summed: +1/-1 per change,
    grouped per frame, then a running sum over the session. Nothing is expanded per frame.
    """
    max_lost = max_time_lost() if max_lost is None else max_lost
    seen = following(_sightings(detections), TRACK, "frame_number", "next_frame", size)
    s, n = F.col("frame_number"), F.col("next_frame")
    expiry = s + max_lost + 1
    gone = n.isNull() | (n > expiry)

    def change(frame, lost, removed, when):
        point = F.struct(frame.alias("frame_number"), F.lit(lost).alias("lost"), F.lit(removed).alias("removed"))
        return F.when(when, point)

    points = F.array(
        change(s + 1, 1, 0, n.isNull() | (n > s + 1)),
        change(expiry, -1, 1, gone),
        change(n, -1, 0, ~gone & (n > s + 1)),
        change(n, 0, -1, gone & n.isNotNull()),
    )
    changes = seen.select(*SESSION, F.explode(F.filter(points, lambda p: p.isNotNull())).alias("p")).select(
        *SESSION, "p.*", F.lit(0).alias("active")
    )
    sighted = seen.select(*FRAME, F.lit(0).alias("lost"), F.lit(0).alias("removed"), F.lit(1).alias("active"))
    zero = frames.select(*FRAME, *[F.lit(0).alias(c) for c in ("lost", "removed", "active")])
    per_frame = (
        changes.unionByName(sighted)
        .unionByName(zero)
        .groupBy(*FRAME)
        .agg(F.sum("active").alias("active"), F.sum("lost").alias("d_lost"), F.sum("removed").alias("d_removed"))
    )
    per_frame = cut_lineage(per_frame)
    summed = running_sum(per_frame, SESSION, "frame_number", {"lost": "d_lost", "removed": "d_removed"}, size)
    last = detections.groupBy(*SESSION).agg(F.max("frame_number").alias("session_last"))
    return (
        summed.join(last, list(SESSION))
        .filter("frame_number <= session_last")
        .select(*FRAME, "active", "lost", "removed")
    )


def rolling_fps(frame_metrics: DataFrame, window: int = 100, every: int = 100, size: int = 4096) -> DataFrame:
    """Mean of the last ``window`` frame rates, at every ``every``-th frame of a run."""
    haloed = with_halo(frame_metrics.select("run_id", "frame", "fps"), ["run_id"], "frame", window - 1, size)
    recent = inside(["run_id"], "frame").rowsBetween(-(window - 1), W.currentRow)
    rolled = haloed.withColumn("rolling_fps", F.avg("fps").over(recent))
    return rolled.filter(f"NOT _halo AND frame % {every} = 0").select("run_id", "frame", "rolling_fps")


def frame_latency_attach(events: DataFrame, frame_metrics: DataFrame) -> DataFrame:
    """Give each event the processing latency of its frame."""
    latency = frame_metrics.select(
        "run_id", F.col("frame").alias("frame_number"), F.col("total_ms").alias("processing_latency_ms")
    )
    return events.join(latency, ["run_id", "frame_number"], "left")
