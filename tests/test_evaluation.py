"""Matching against brute force on overlapping boxes, and identity scores on tangled tracks."""

import itertools
import random

import numpy as np
import pytest

from kerbline.operators import assign
from kerbline.operators import evaluation as ev
from kerbline.operators.assign import best_pairs, solve_edges
from kerbline.operators.graph import connected_components

BOXES = "sequence_id STRING, frame BIGINT, id BIGINT, bb_left DOUBLE, bb_top DOUBLE, bb_w DOUBLE, bb_h DOUBLE, conf DOUBLE, class_id INT"


def best_total(w):
    """Largest total of a one-to-one choice, by trying all."""
    if w.shape[0] > w.shape[1]:
        w = w.T
    n, m = w.shape
    return max((sum(w[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n)), default=0.0)


def test_best_pairs_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(300):
        w = rng.random((rng.integers(1, 6), rng.integers(1, 7)))
        w[rng.random(w.shape) < 0.4] = 0
        pairs = best_pairs(w)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        assert sum(w[i, j] for i, j in pairs) == pytest.approx(best_total(w))


def test_solve_edges_splits_components():
    left, right = np.array([10, 10, 20, 30]), np.array([1, 2, 2, 9])
    assert solve_edges(left, right, np.array([0.9, 0.8, 0.7, 0.1])).tolist() == [True, False, True, True]


def test_components_of_one_shape_are_solved_together(monkeypatch):
    """The choices are those of each component on its own, ties included, and the steps do not grow with the components."""
    rng = np.random.default_rng(3)
    edges = [(100 * k + i, 100 * k + j) for k in range(600) for i in range(rng.integers(1, 5)) for j in range(rng.integers(1, 5)) if rng.random() < 0.6]
    left, right = np.array(edges).T
    weight = rng.integers(1, 4, len(edges)) / 4
    want = np.concatenate([solve_edges(*(x[left // 100 == k] for x in (left, right, weight))) for k in np.unique(left // 100)])
    calls = []
    monkeypatch.setattr(assign, "best_pairs", lambda w: calls.append(w.shape) or best_pairs(w))
    assert (solve_edges(left, right, weight) == want).all() and len(calls) == len(set(calls)) <= 16
    for _ in range(50):
        w = rng.integers(0, 4, (5, rng.integers(1, 6), rng.integers(1, 6))) / 4
        chosen = assign.best_columns(w)
        assert [[(i, j) for i, j in enumerate(row) if j >= 0] for row in chosen.tolist()] == [best_pairs(one) for one in w]


def crowd(seed, n_frames=40):
    rng = random.Random(seed)
    gt, pred = [], []
    for frame in range(1, n_frames + 1):
        for side in (gt, pred):
            for i in range(rng.randint(0, 6)):
                side.append(("s", frame, i, rng.uniform(0, 60), rng.uniform(0, 60), 50.0, 50.0, 1.0, 1))
    return gt, pred


def box_iou(a, b):
    w = max(0, min(a[3], b[3]) + 50 - max(a[3], b[3]))
    h = max(0, min(a[4], b[4]) + 50 - max(a[4], b[4]))
    return w * h / (5000 - w * h)


def test_frame_assignment_equals_brute_force(spark):
    gt, pred = crowd(7)
    got = {}
    pairs = ev.frame_assignment(spark.createDataFrame(gt, BOXES), spark.createDataFrame(pred, BOXES), threshold=0.0)
    for r in pairs.collect():
        got.setdefault(r.frame, []).append((r.gt_id, r.pred_id, r.iou))
    for frame in range(1, 41):
        a, b = [g for g in gt if g[1] == frame], [p for p in pred if p[1] == frame]
        chosen = got.get(frame, [])
        assert len({x for x, _, _ in chosen}) == len({y for _, y, _ in chosen}) == len(chosen)
        w = np.array([[box_iou(x, y) for y in b] for x in a]).reshape(len(a), len(b))
        assert sum(s for _, _, s in chosen) == pytest.approx(best_total(w) if w.size else 0.0)


def test_threshold_applies_after_assignment(spark):
    gt, pred = crowd(8)
    g, p = spark.createDataFrame(gt, BOXES), spark.createDataFrame(pred, BOXES)
    everything = {(r.frame, r.gt_id, r.pred_id) for r in ev.frame_assignment(g, p, 0.0).filter("iou >= 0.5").collect()}
    assert {(r.frame, r.gt_id, r.pred_id) for r in ev.frame_assignment(g, p, 0.5).collect()} == everything


def test_track_assignment_on_tangled_tracks(spark):
    rng = random.Random(4)
    for _ in range(3):
        w = np.array([[rng.choice([0, 0, rng.randint(1, 9)]) for _ in range(6)] for _ in range(5)], dtype=float)
        edges = [("s", i, j, int(w[i, j])) for i in range(5) for j in range(6) if w[i, j]]
        edges += [("s", 100, 200, 3), ("s", 100, 201, 8), ("s", 300, 400, 2), ("s", 301, 400, 5)]
        df = spark.createDataFrame(edges, "sequence_id STRING, gt_id BIGINT, pred_id BIGINT, frames BIGINT")
        rows = ev.track_assignment(df).collect()
        assert len({r.gt_id for r in rows}) == len({r.pred_id for r in rows}) == len(rows)
        assert sum(r.frames for r in rows) == pytest.approx(best_total(w) + 8 + 5)


def test_connected_components(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(0, 60)]
    edges = [*chain, ("x1", "x2"), ("x3", "x2"), ("y", "y")]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a STRING, b STRING")).collect()}
    assert all(got[f"n{i:03d}"] == "n000" for i in range(61))
    assert got["x1"] == got["x2"] == got["x3"] == "x1"


def test_switches_survive_gaps(spark):
    rows = [("s", 1, 1, 5), ("s", 2, 1, 5), ("s", 9, 1, 6), ("s", 10, 1, 5), ("s", 3, 2, 5)]
    matches = spark.createDataFrame(rows, "sequence_id STRING, frame BIGINT, gt_id BIGINT, pred_id BIGINT")
    got = sorted((r.frame, r.prev_pred_id, r.pred_id) for r in ev.id_switches(matches, size=2).collect())
    assert got == [(9, 5, 6), (10, 6, 5)]


def test_empty_sides(spark):
    gt, pred = crowd(9, 3)
    g, none = spark.createDataFrame(gt, BOXES), spark.createDataFrame([], BOXES)
    r = ev.clear_mot(g, none, ev.frame_assignment(g, none)).first()
    assert (r.mota, r.motp, r.idf1, r.precision, r.fn, r.fp) == (0.0, 0.0, 0.0, 0.0, len(gt), 0)
    r = ev.clear_mot(none, g, ev.frame_assignment(none, g)).first()
    assert (r.mota, r.recall, r.fp) == (0.0, 0.0, len(gt))


@pytest.mark.parametrize("shape", ["sparse", "tangled", "equal weights", "drifting tracks"])
def test_dominant_pairs_keep_the_best_total(spark, shape):
    rng = random.Random(shape)
    edges = {}
    for unit in "ab":
        for _ in range({"sparse": 60, "tangled": 160, "equal weights": 90}.get(shape, 0)):
            edges[unit, rng.randrange(25), rng.randrange(25)] = 3 if shape == "equal weights" else rng.randrange(1, 40)
        for g in range(30 if shape == "drifting tracks" else 0):  # a chain: each track passes its prediction on to the next
            edges |= {(unit, g, g): rng.randrange(20, 50), (unit, g, g + 1): rng.randrange(1, 9), (unit, g + 1, g): rng.randrange(1, 9)}
    rows = [(*k, w) for k, w in edges.items()]
    df = spark.createDataFrame(rows, "sequence_id STRING, gt_id BIGINT, pred_id BIGINT, frames BIGINT")
    taken, left = ev.dominant_pairs(df)
    got = ev.track_assignment(df).collect()
    for unit in "ab":
        own = [r for r in got if r.sequence_id == unit]
        assert len({r.gt_id for r in own}) == len({r.pred_id for r in own}) == len(own)
        assert all(edges[unit, r.gt_id, r.pred_id] == r.frames for r in own)
        g, p, w = (np.array(c) for c in zip(*((k[1], k[2], w) for k, w in edges.items() if k[0] == unit), strict=True))
        assert sum(r.frames for r in own) == w[solve_edges(g, p, w.astype(float))].sum()
    if shape == "drifting tracks":
        assert left.isEmpty() and taken.count() > 40
