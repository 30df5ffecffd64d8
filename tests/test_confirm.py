"""The confirmation rule against a frame-by-frame simulation, for whole and chunked tracks."""

import random
from collections import defaultdict

import pytest

from kerbline.operators import confirm as c
from kerbline.operators.detections import FRAME
from kerbline.params import Confirmation
from kerbline.schemas import DETECTION

MOTORCYCLE_BOX = (0.0, 0.0, 100.0, 100.0)
RIDING_BOX = (10.0, 10.0, 60.0, 90.0)
WALKING_BOX = (500.0, 500.0, 560.0, 600.0)


def scene(seed: int, n_frames: int = 90, n_tracks: int = 5):
    """Random frames: some empty, riders on and off a motorcycle, class flips, drop-outs."""
    rng = random.Random(seed)
    rows = []
    session = f"s{seed}"
    for camera in (0, 1):
        for frame in range(1, n_frames + 1):
            if rng.random() < 0.15:
                continue
            rows.append((camera, session, frame, 0, 900, 2, 0.9, *MOTORCYCLE_BOX))
            for t in range(n_tracks):
                if rng.random() < 0.35:
                    continue
                class_id = 1 if rng.random() < 0.8 else 0
                box = RIDING_BOX if rng.random() < 0.6 else WALKING_BOX
                rows.append((camera, session, frame, t + 1, t, class_id, rng.randint(30, 99) / 100, *box))
    return rows


def simulate(rows, rule):
    """Confirmed (camera session, track) -> (frame, mean confidence), one frame after the other."""
    frames = defaultdict(list)
    for r in rows:
        frames[((r[0], r[1]), r[2])].append(r)
    found, streak, missing, scores = {}, defaultdict(dict), defaultdict(dict), defaultdict(dict)
    for camera, frame in sorted(frames):
        present = set()
        for r in frames[(camera, frame)]:
            track, class_id = r[4], r[5]
            if class_id != rule.trigger_class:
                continue
            present.add(track)
            if (camera, track) in found or tuple(r[7:]) != RIDING_BOX:
                continue
            streak[camera][track] = streak[camera].get(track, 0) + 1
            missing[camera][track] = 0
            scores[camera].setdefault(track, []).append(r[6])
            if streak[camera][track] >= rule.frames:
                found[(camera, track)] = (frame, sum(scores[camera][track]) / len(scores[camera][track]))
        for track in streak[camera]:
            if track not in present:
                missing[camera][track] = missing[camera].get(track, 0) + 1
                if missing[camera][track] > rule.patience:
                    streak[camera][track], missing[camera][track], scores[camera][track] = 0, 0, []
    return found


@pytest.mark.parametrize("frames,patience,size", [(1, 2, 9), (3, 2, 1 << 16), (3, 2, 1), (5, 2, 4), (5, 1, 7), (8, 3, 30)])
def test_equals_simulation(spark, frames, patience, size):
    rule = Confirmation(frames=frames, patience=patience)
    rows = [r for seed in range(1, 9) for r in scene(seed)]
    df = spark.createDataFrame(rows, DETECTION)
    want = {k: (f, round(m, 9)) for k, (f, m) in simulate(rows, rule).items()}
    got = {
        ((r.camera_id, r.session_id), r.track_id): (r.frame_number, round(r.confidence, 9))
        for r in c.confirmed_violations(df, rule, size).collect()
    }
    assert got == want


def test_zero_means_default():
    assert Confirmation(frames=0, patience=0) == Confirmation()


def test_streaks_do_not_depend_on_the_chunk_size(spark):
    df = spark.createDataFrame(scene(11), DETECTION).cache()
    key = [*FRAME, "track_id", "kind", "streak", "misses"]
    whole = sorted(map(tuple, c.streak_state(df).select(*key).na.fill(-9).collect()))
    for size in (1, 3, 10):
        assert sorted(map(tuple, c.streak_state(df, size=size).select(*key).na.fill(-9).collect())) == whole


def test_rider_without_motorcycle_is_not_riding(spark):
    df = spark.createDataFrame([(0, "s0", 1, 0, 1, 1, 0.9, *RIDING_BOX)], DETECTION)
    assert c.confirmed_violations(df, Confirmation(frames=1)).count() == 0
    assert c.detection_status(df).first().status == "NO MOTOR"


def test_untracked_rider_has_a_status(spark):
    rows = [(0, "s0", 1, 0, None, 0, 0.9, *RIDING_BOX), (0, "s0", 1, 1, 5, 2, 0.9, *MOTORCYCLE_BOX)]
    got = {r.det_idx: r.status for r in c.detection_status(spark.createDataFrame(rows, DETECTION)).collect()}
    assert got == {0: "SAFE", 1: "MOTOR"}
