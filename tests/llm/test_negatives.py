"""Hard negatives against all pairs in plain Python."""

import math
import random
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import op11_negatives as mining

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, vec string, cluster int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "a", "b", 3) for i, v, y in rows], SCHEMA).repartition(5)


def brute(rows, every, positives=5, mined=5, low=80):
    own = {}
    for i, v, y in rows:
        if i is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) if abs(x) < 1e300 else 10**40 for x in v]
        if sum(x * x for x in q) >= 2**62:
            continue
        found = (y, struct.pack(f"<{len(q)}i", *q), q)
        own[i] = min(own.get(i, found), found)
    out = Counter()
    for a, (y, _, q) in own.items():
        if a % every:
            continue
        pairs = [(-sum(m * n for m, n in zip(q, r, strict=True)), b, z) for b, (z, _, r) in own.items() if b != a and len(r) == len(q)]
        pairs.sort()
        for s, p, _ in [x for x in pairs if x[2] == y][:positives]:
            fit = [(t, b) for t, b, z in pairs if z != y and -low * s <= -100 * t <= -100 * s][:mined]
            out.update((a, p, k, b, -s, -t) for k, (t, b) in enumerate(fit, 1))
    return out


def cases(kind):
    rng = random.Random(kind)
    near = lambda c, w: [x + rng.gauss(0, w) for x in c]
    if kind == "clustered":
        centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(6)]
        return [(k, near(rng.choice(centres), 0.15), rng.randrange(4)) for k in range(500)]
    if kind == "hot vector":
        one = [0.1 * x for x in range(8)]
        return [(k, one if k % 3 else near(one, 0.05), rng.choice([0, 0, 1, 2])) for k in range(600)]
    if kind == "hot label":
        return [(k, [rng.gauss(0, 1) for _ in range(5)], 0 if k % 3 else k % 7) for k in range(300)]
    if kind == "large":  # products beyond 2**53
        return [(k, [rng.gauss(0, 2.0**18) for _ in range(4)], k % 3) for k in range(120)]
    rows = [(k, [rng.gauss(0, 1) for _ in range(rng.choice([1, 3, 3, 4]))], rng.choice([1, 2, None])) for k in range(160)]
    rows += [(200, None, 1), (210, [], 1), (211, [], 2), (212, [], 1), (220, [0.0] * 3, 1), (221, [0.0] * 3, 2), (230, [1.0, None, 2.0], 1)]
    rows += [(240, [math.nan] * 3, 2), (250, [math.inf, 0.0, 0.0], 1), (260, [1e9, 0.0, 0.0], 1), (270, [1e308, 0.0, 0.0], 2), (None, [1.0] * 3, 1)]
    return rows + [(10, [5.0, 5.0, 5.0], 2)] * 30 + [(10, [5.0, 5.0, 5.1], 1), (-40, [1.0, 1.0, 1.0], 1), (-40, [1.0, 1.0, 1.0], 1)]


@pytest.mark.parametrize("kind", ["clustered", "hot vector", "hot label", "large", "awkward"])
def test_rows_equal_all_pairs(spark, monkeypatch, kind):
    # Small blocks cut lists and anchors, and tests for the end come after a few rows.
    monkeypatch.setattr(mining, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(mining, "TURN_BYTES", 700)
    monkeypatch.setattr(mining, "WALK", 8)
    rows = cases(kind)
    got = mining.negatives(table(spark, rows), F.col("vec_id") % 10 == 0, F.col("label"))
    want = brute(rows, 10)
    assert want and Counter(map(tuple, got.collect())) == want


def test_other_parameters(spark):
    rows = cases("clustered")
    got = mining.negatives(table(spark, rows), F.col("vec_id") % 25 == 0, F.col("label"), positives=2, mined=7, low=10)
    assert Counter(map(tuple, got.collect())) == brute(rows, 25, 2, 7, 10)


def test_no_rows(spark):
    for rows in ([], [(0, [1.0], 1)], [(1, [1.0], 1), (2, [1.0], 2)], [(0, None, None)]):
        assert mining.negatives(table(spark, rows), F.col("vec_id") % 10 == 0, F.col("label")).count() == 0


def test_the_walk_ends_early():
    """A list is left once its bound certifies what was found."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(2, 16)) * 200
    vectors = np.floor(np.concatenate([centre[0] + rng.normal(size=(300, 16)), -centre[0] + rng.normal(size=(2000, 16))]))
    norms = np.sqrt((vectors**2).sum(1))
    fitted = mining.centroids(vectors[:50], 1)
    angle = np.arccos(mining._cosines(vectors, norms, fitted))[:, 0]
    bound = norms * np.cos(np.maximum(angle - angle[:50].max() - mining.SLACK, 0))
    import pandas as pd

    blobs = [v.astype("<i4").tobytes() for v in vectors]
    base = pd.DataFrame({"bound": bound, "vec_id": np.arange(2300), "label": 0, "norm": norms, "vec": blobs})
    asked = pd.DataFrame({"rep": [0], "label": 0, "norm": norms[:1], "vec": blobs[:1]})
    walk, need, steps = mining._Walk(base, asked), np.array([-np.inf]), 0
    found = defaultdict(int)
    for some, rows, scores in walk.steps(need):
        steps += 1
        for i, s in zip(walk.ids[rows].tolist(), scores[0].tolist(), strict=True):
            found[i] = s
        need[:] = sorted(found.values())[-6]
    assert steps == 1 and sorted(found, key=lambda i: -found[i])[:6] == np.argsort(-(vectors @ vectors[0]), kind="stable")[:6].tolist()
