"""The N-frame confirmation rule on a stream of frames.

One message is one non-empty frame: its number, its tick and its boxes. Association happens
inside the message; its trigger rows then wait until the watermark has passed them, the tracks dealt to ``GROUPS`` entries of the state,
(:mod:`kerbline.streaming.ordered_state`), so frames may arrive in any order within the watermark delay. What is
carried on is small: clock of the last hit, frozen rows, streak, sum of confidences. Misses need no rows, they
follow from the clock at the next hit.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.functions import geometry as g
from kerbline.functions.labels import violation_type
from kerbline.operators.confirm import RULE, TRACK, frame_ticks
from kerbline.operators.detections import BOX, FRAME
from kerbline.params import MOTORCYCLE, Confirmation
from kerbline.streaming.ordered_state import InTimeOrder, in_time_order, micros

BOX_FIELDS = ("det_idx", "track_id", "class_id", "confidence", *BOX)
OUTPUT = (
    "camera_id long, session_id string, track_id long, frame_number long, class_id int, confidence double, "
    "x1 double, y1 double, x2 double, y2 double"
)
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


def frame_messages(detections: DataFrame, start: str = "2024-01-01 00:00:00", fps: int = 25) -> DataFrame:
    """Batch helper: one row per non-empty frame with its time, its tick and its boxes.

    A frame holds what one detector call returned, a bounded list.
    """
    boxes = F.sort_array(F.collect_list(F.struct(*BOX_FIELDS))).alias("boxes")
    at = F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + F.expr(f"frame_number * 1000000 div {fps}"))
    framed = detections.groupBy(*FRAME).agg(boxes).join(frame_ticks(detections), list(FRAME))
    return framed.withColumn("frame_time", at)


def trigger_rows(messages: DataFrame, rule: Confirmation = RULE) -> DataFrame:
    """Tracked trigger boxes of each frame, flagged as hit or frozen. Stateless."""

    def corners(b):
        return tuple(b[c] for c in BOX)

    motorcycles = F.filter("boxes", lambda b: b["class_id"] == MOTORCYCLE)
    riders = F.filter("boxes", lambda b: (b["class_id"] == rule.trigger_class) & b["track_id"].isNotNull())
    marked = F.transform(
        riders,
        lambda r: F.struct(
            r.alias("box"),
            F.exists(motorcycles, lambda m: g.ioa(corners(r), corners(m)) >= rule.ioa).alias("hit"),
        ),
    )
    return messages.select(*FRAME, "frame_time", "tick", F.explode(marked).alias("r")).select(
        "camera_id", "session_id", "r.box.track_id", "frame_number", "frame_time", "tick", "r.hit", "r.box.class_id",
        "r.box.confidence", *[f"r.box.{c}" for c in BOX],
    )


@dataclass(frozen=True)
class Streak:
    """What a track carries from frame to frame."""

    seen_ms: int = 0
    last_tick: int = -1
    clock: int | None = None
    frozen: int = 0
    length: int = 0
    total: float = 0.0
    violated: bool = False


NEW = Streak()
#: Entries of the state that tracks are dealt to. Each costs some calls per batch, however many tracks it holds.
GROUPS = 4096


def _tracks(rows) -> tuple[np.ndarray, list[str]]:
    """Number of each row's track, and the names of the tracks."""
    code, names = pd.factorize(rows["key_name"])
    return code, names.tolist()


class _Confirm(InTimeOrder):
    """Streaks of the tracks of a group, in the order of their ticks. The carried state is a streak per track."""

    time, ties, several = "frame_time", ("tick",), True

    def __init__(self, rule: Confirmation, idle_ms: int):
        self.rule, self.idle_ms = rule, idle_ms

    def wanted(self, carry, rows):
        carry = dict(carry or {})
        code, names = _tracks(rows)
        seen = np.zeros(len(names), np.int64)
        np.maximum.at(seen, code, micros(rows["frame_time"]) // 1000)
        open_ = np.ones(len(names), bool)
        for i, (name, at) in enumerate(zip(names, seen.tolist(), strict=True)):
            streak = carry.get(name, NEW)
            carry[name] = replace(streak, seen_ms=max(streak.seen_ms, at))
            open_[i] = not streak.violated
        return carry, rows if open_.all() else rows[open_[code]]

    def expires(self, carry):
        return min(s.seen_ms for s in carry.values()) + self.idle_ms if carry else None

    def pruned(self, carry, mark):
        return {name: s for name, s in carry.items() if s.seen_ms + self.idle_ms > mark} if carry else None

    def judge(self, carry, rows):
        carry = dict(carry or {})
        code, names = _tracks(rows)
        streaks = [carry.get(name, NEW) for name in names]
        held = {f: np.array([getattr(s, f) for s in streaks]) for f in ("last_tick", "frozen", "length", "total", "violated")}
        started = np.array([s.clock is not None for s in streaks])
        held["clock"] = np.array([s.clock or 0 for s in streaks])
        # The same frame again is a repeat; what is behind the last tick otherwise was late and is counted by Spark.
        tick = rows["tick"].to_numpy(np.int64)
        fresh = (tick > held["last_tick"][code]) & ~held["violated"][code]
        fresh[fresh] = ~pd.DataFrame({"code": code[fresh], "tick": tick[fresh]}).duplicated().to_numpy()
        # Track by track, in the order of time.
        order = np.flatnonzero(fresh)
        order = order[np.argsort(code[order], kind="stable")]
        if not len(order):
            return carry, None
        code, tick, hit = code[order], tick[order], rows["hit"].to_numpy(bool)[order]
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        ends = np.append(starts[1:], len(code)) - 1
        which = code[starts]
        frozen = np.cumsum(~hit)
        frozen += np.repeat(held["frozen"][which] - (frozen - ~hit)[starts], np.diff(np.append(starts, len(code))))
        for t, last, still in zip(which.tolist(), tick[ends].tolist(), frozen[ends].tolist(), strict=True):
            carry[names[t]] = replace(streaks[t], last_tick=last, frozen=still)
        at = np.flatnonzero(hit)
        if not len(at):
            return carry, None
        owner, clock, confidence = code[at], (tick - frozen)[at], rows["confidence"].to_numpy(np.float64)[order[at]]
        number = np.arange(len(at))
        first = np.diff(owner, prepend=-1) != 0
        step = clock - np.where(first, held["clock"][owner], np.roll(clock, 1))
        opens = (step > self.rule.patience + 1) | (first & ~started[owner])
        # The first hit of each one's streak here; the streak may have begun before these rows.
        begin = np.maximum.accumulate(np.where(opens | first, number, 0))
        older = ~opens[begin]
        length = number - begin + 1 + np.where(older, held["length"][owner], 0)
        done = length >= self.rule.frames
        # Of each track the first hit that confirms, else the last one.
        heads = np.flatnonzero(first)
        i = np.append(heads[1:], len(at)) - 1
        reached = np.flatnonzero(done)
        owners, earliest = np.unique(owner[reached], return_index=True)
        i[np.searchsorted(owner[heads], owners)] = reached[earliest]
        sums = np.add.reduceat(np.append(confidence, 0.0), np.column_stack([begin[i], i + 1]).ravel())[::2]
        total = sums + np.where(older[i], held["total"][owner[i]], 0.0)
        for t, c, n, s, v in zip(owner[i].tolist(), clock[i].tolist(), length[i].tolist(), total.tolist(), done[i].tolist(), strict=True):
            carry[names[t]] = replace(carry[names[t]], clock=c, length=n, total=s, violated=v)
        confirmed = done[i]
        if not confirmed.any():
            return carry, None
        found = rows.iloc[order[at[i[confirmed]]]]
        return carry, found.assign(confidence=(total / length[i])[confirmed])[COLUMNS]


def confirm_stream(
    messages: DataFrame, rule: Confirmation = RULE, delay: str = "1 minute", idle_seconds: int = 600
) -> DataFrame:
    """Confirmed violations of a frame stream, one per track: the rows of the batch rule for frames that
    come within the watermark delay, in any order and any batches.

    Frames later than that are dropped by Spark and counted (:class:`kerbline.streaming.events.LateRows`). A violation comes
    out once the watermark has passed its frame; a message without boxes, later than all frames, releases what
    waits after a drain. State of a track is dropped after ``idle_seconds`` of event time without a row; a tracker gives up
    on a lost track within seconds and does not use its id again.
    """
    rows = trigger_rows(messages.withWatermark("frame_time", delay), rule)
    found = in_time_order(rows, list(TRACK), _Confirm(rule, idle_seconds * 1000), OUTPUT, GROUPS)
    return found.select(
        F.md5(F.concat_ws("|", *TRACK)).alias("event_id"),
        *TRACK,
        "frame_number",
        violation_type(F.col("class_id")).alias("violation_type"),
        "confidence",
        *[F.col(c).cast("int").alias(f"bbox_{c}") for c in BOX],
    )
