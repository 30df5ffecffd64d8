"""Rows in event-time order: buckets in a made-up state, then streams with frames out of order."""

import os
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kerbline.operators.confirm import confirmed_violations
from kerbline.operators.dedup import dedup_batch
from kerbline.params import Confirmation
from kerbline.plans import inputs
from kerbline.streaming import confirm as sc
from kerbline.streaming import events as se
from kerbline.streaming import ordered_state as os_

START = datetime(2024, 1, 15)


class Value:
    def __init__(self):
        self.data = None

    def get(self):
        return self.data

    def update(self, data):
        self.data = data

    def clear(self):
        self.data = None


class Map(dict):
    def getValue(self, key):  # noqa: N802
        return self.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self[key] = value

    def removeKey(self, key):  # noqa: N802
        del self[key]


class Handle:
    """State and timers of one key."""

    def __init__(self):
        self.value, self.map, self.timers = Value(), Map(), set()

    def getValueState(self, *_):  # noqa: N802
        return self.value

    def getMapState(self, *_):  # noqa: N802
        return self.map

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


class Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.at

    getExpiryTimeInMs = getCurrentWatermarkInMs  # noqa: N815


def _split(rows, n):
    return [rows.iloc[part] for part in np.array_split(np.arange(len(rows)), n)]


def drive(rule, key, batches, delay_ms):
    """Micro-batches as Spark runs them: rows, then timers at the watermark of the batches before."""
    handle, mark, out, held = Handle(), 0, [], 0
    rule.init(handle)

    def fire():
        while due := sorted(t for t in handle.timers if t <= mark):
            handle.timers.discard(due[0])
            out.extend(rule.handleExpiredTimer(key, Clock(mark), Clock(due[0])))

    for batch in batches:
        late = os_.micros(batch[rule.time]) <= mark * 1000
        if not late.all():
            list(rule.handleInputRows(key, iter(_split(batch[~late], 3)), Clock(mark)))
        fire()
        held = max(held, len(handle.map))
        mark = max(mark, int(os_.micros(batch[rule.time]).max()) // 1000 - delay_ms)
        fire()
    mark = 10**15
    fire()
    assert not handle.map and handle.value.data is None and not handle.timers
    return pd.concat(out) if out else pd.DataFrame()


def event_frame(seconds):
    ids = [f"e{i:06d}" for i in range(len(seconds))]
    at = pd.to_datetime(START) + pd.to_timedelta(np.asarray(seconds) * 1000, unit="ms")
    return pd.DataFrame({"event_id": ids, "event_timestamp": at})


@pytest.mark.parametrize("cuts", [1, 2, 17])
@pytest.mark.parametrize("shape", ["spread", "one time", "shuffled"])
def test_buckets_stay_small(monkeypatch, cuts, shape):
    rng = np.random.default_rng(cuts)
    n = 30_000
    seconds = {"spread": np.arange(n) * 0.01, "one time": np.repeat([5.0, 5.0, 90.0], n // 3), "shuffled": rng.permutation(n) * 0.02}[shape]
    rows = event_frame(seconds)
    monkeypatch.setattr(os_, "MOST", 500)
    seen = []
    rule = se._FirstAfterHorizon(1_000_000, list(rows.columns))
    plain = rule.judge
    rule.judge = lambda carry, part: seen.append(len(part)) or plain(carry, part)
    got = drive(rule, ("k",), _split(rows, cuts), 10**9)
    at = os_.micros(rows.sort_values(["event_timestamp", "event_id"])["event_timestamp"])
    want, last = [], None
    for t in at.tolist():
        if last is None or t > last + 1_000_000:
            want.append(t)
            last = t
    assert os_.micros(got["event_timestamp"]).tolist() == want
    assert sum(seen) == n and (shape == "one time" or max(seen) <= 1000)


def test_late_rows_alone_are_missing():
    """Within the delay nothing is lost; behind it Spark drops."""
    rows = event_frame([0, 100, 50, 300, 299, 10, 400])
    got = drive(se._FirstAfterHorizon(0, list(rows.columns)), ("k",), [rows.iloc[i : i + 1] for i in range(7)], 60_000)
    assert sorted(got["event_id"]) == ["e000000", "e000001", "e000002", "e000003", "e000004", "e000006"]


def stream_of(spark, folder, parts, schema):
    for i, part in enumerate(parts):
        name = f"{folder}/{i:03d}"
        part.coalesce(1).write.parquet(name)
        for f in os.listdir(name):
            os.utime(f"{name}/{f}", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


@pytest.mark.parametrize("rule", [Confirmation(), Confirmation(frames=5, patience=1)])
def test_shuffled_frames_give_the_batch_rows(spark, sf_dir, tmp_path, rule):
    detections = inputs.detections(spark, sf_dir)
    messages = sc.frame_messages(detections)
    staged = f"{tmp_path}/staged"
    messages.write.parquet(staged)
    frames = spark.read.parquet(staged)
    # Frames move by up to 120 numbers, 5 seconds, between five files; the last one only moves the watermark.
    group = F.least(F.lit(4), F.floor((F.col("frame_number") + F.pmod(F.xxhash64("camera_id", "frame_number"), F.lit(120))) / 110))
    parts = [frames.filter(group == i) for i in range(5)]
    beat = frames.limit(1).withColumns({"frame_time": F.col("frame_time") + F.expr("INTERVAL 1 DAY"), "boxes": F.expr("filter(boxes, b -> false)")})
    counter = se.LateRows()
    spark.streams.addListener(counter)
    query = (
        sc.confirm_stream(stream_of(spark, f"{tmp_path}/in", [*parts, beat], frames.schema), rule)
        .writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    spark.streams.removeListener(counter)
    got, want = spark.read.parquet(f"{tmp_path}/out"), confirmed_violations(detections, rule)
    rows = lambda df: sorted((*r[:-5], round(r["confidence"], 9), *r[-4:]) for r in df.select(want.columns).collect())
    assert rows(got) == rows(want) and counter.dropped[str(query.id)] == 0


def test_many_waiting_rows_of_one_key(spark, tmp_path, monkeypatch):
    """A backlog of one key drains through buckets."""
    rng = random.Random(4)
    schema = "event_id STRING, track_id INT, event_timestamp TIMESTAMP, camera_id STRING"
    rows = [(f"e{i:05d}", 1, START + timedelta(milliseconds=rng.randrange(40_000_000)), "cam") for i in range(30_000)]
    parts = [spark.createDataFrame(rows[k::3], schema) for k in range(3)]
    parts.append(spark.createDataFrame([(None, None, START + timedelta(days=3), None)], schema))
    query = (
        se.dedup_stream(stream_of(spark, f"{tmp_path}/in", parts, schema), watermark="1 day")
        .writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted(r.event_id for r in dedup_batch(spark.createDataFrame(rows, schema), 30).collect())


def track_frame(rng, tracks, ticks):
    rows = [(f"t{t}", t, k) for t in range(tracks) for k in range(1, ticks + 1) if rng.random() < 0.5]
    frame = pd.DataFrame(rows, columns=["key_name", "track_id", "tick"])
    frame["frame_number"] = frame["tick"]
    frame["frame_time"] = pd.to_datetime(START) + pd.to_timedelta(frame["tick"] * 40, unit="ms")
    frame["hit"] = rng.random(len(frame)) < 0.6
    frame["confidence"] = rng.integers(30, 100, len(frame)) / 100
    return frame.assign(camera_id=1, session_id="s", class_id=1, x1=0.0, y1=0.0, x2=1.0, y2=1.0)


@pytest.mark.parametrize("cuts", [1, 3, 12])
@pytest.mark.parametrize("most", [40, 8192])
def test_tracks_of_a_group_are_judged_one_by_one(monkeypatch, cuts, most):
    """Tracks share an entry of the state; each has the violation that it has alone, by a plain loop."""
    monkeypatch.setattr(os_, "MOST", most)
    rng = np.random.default_rng(cuts)
    rows = track_frame(rng, 30, 60)
    want = {}
    for track, own in rows.groupby("track_id"):
        clock, frozen, streak = None, 0, []
        for r in own.itertuples():
            frozen += not r.hit
            if r.hit and track not in want:
                now = r.tick - frozen
                streak = [*streak, r.confidence] if clock is not None and now - clock <= 3 else [r.confidence]
                clock = now
                if len(streak) == 3:
                    want[track] = (r.frame_number, round(sum(streak) / 3, 9))
    again = pd.concat([rows, rows.iloc[::7]])  # some rows come twice
    for order in (np.arange(len(again)), rng.permutation(len(again))):
        got = drive(sc._Confirm(Confirmation(), 600_000), ("g",), _split(again.iloc[order], cuts), 10**9)
        found = {r.track_id: (r.frame_number, round(r.confidence, 9)) for r in got.itertuples()}
        assert found == want and len(got) == len(want) > 15


def test_idle_tracks_of_a_group_are_forgotten():
    """A track without rows for the idle time leaves the state, while others of its group go on."""
    rng = np.random.default_rng(5)
    rows = track_frame(rng, 6, 9)
    late = rows.assign(frame_time=rows["frame_time"] + pd.to_timedelta(rows["track_id"] * 100, unit="s"))
    rule, handle = sc._Confirm(Confirmation(), 50_000), Handle()
    rule.init(handle)
    held = []
    for track in range(6):
        mark = int(os_.micros(pd.Series([START + timedelta(seconds=100 * track)]))[0]) // 1000 - 20_000
        own = late[late["track_id"] == track]
        list(rule.handleInputRows(("g",), iter([own]), Clock(mark)))
        for at in (mark, mark + 30_000):
            while due := sorted(t for t in handle.timers if t <= at):
                handle.timers.discard(due[0])
                list(rule.handleExpiredTimer(("g",), Clock(at), Clock(due[0])))
        held.append(sorted(rule._load().carry))
    assert held == [[f"t{t}"] for t in range(6)]
