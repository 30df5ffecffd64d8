"""Chunked ordered passes against plain windows, with one key that holds most rows."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.operators import ordered as o
from kerbline.operators.percentiles import bracketed, exact_percentiles
from kerbline.plans import inputs


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for key, n in (("hot", 400), ("b", 3), ("c", 40)):
        at = 0
        for _ in range(n):
            at += rng.choice([1, 1, 2, 15])
            data.append((key, at, rng.randint(-5, 5)))
    return spark.createDataFrame(data, "k STRING, at BIGINT, v BIGINT").cache()


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("size", [1, 4, 33, 1 << 16])
def test_previous_following_and_sums(rows, size):
    w = W.partitionBy("k").orderBy("at")
    same(o.previous(rows, ["k"], "at", {"p": "v"}, size), rows.withColumn("p", F.lag("v").over(w)))
    same(o.following(rows, ["k"], "at", "n", size), rows.withColumn("n", F.lead("at").over(w)))
    same(o.running_sum(rows, ["k"], "at", {"s": "v"}, size), rows.withColumn("s", F.sum("v").over(w)))
    same(o.dense_number(rows, ["k"], "at", "no", size), rows.withColumn("no", F.row_number().over(w).cast("bigint")))


@pytest.mark.parametrize("size", [1, 5, 64])
def test_halo_frames(rows, size):
    depth = 4
    frame = o.inside(["k"], "at").rowsBetween(-depth, 0)
    got = o.with_halo(rows, ["k"], "at", depth, size).withColumn("m", F.sum("v").over(frame)).filter("NOT _halo")
    want = rows.withColumn("m", F.sum("v").over(W.partitionBy("k").orderBy("at").rowsBetween(-depth, 0)))
    same(got.select("k", "at", "v", "m"), want)


def test_running_max(rows):
    one = rows.filter("k = 'hot'")
    want = one.withColumn("m", F.max("v").over(W.orderBy("at").rowsBetween(W.unboundedPreceding, 0)))
    same(o.running_max(one, "at", "v", "m", 7), want)


def test_percentiles_equal_the_built_in(spark):
    rng = random.Random(3)
    data = [("hot", rng.choice([0.0, 1.5, -2.25, rng.random() * 1e-3, rng.gauss(100, 1e-7)])) for _ in range(900)]
    data += [("one", 7.0), ("two", -1.0), ("two", 3.0), ("two", None)]
    df = spark.createDataFrame(data, "k STRING, v DOUBLE")
    probs = [0.0, 0.05, 0.5, 0.95, 0.99, 1.0]
    want = {
        (r.k, p): r.q[i]
        for r in df.groupBy("k").agg(F.percentile("v", probs).alias("q")).collect()
        for i, p in enumerate(probs)
    }
    got = {(r.k, r.prob): r.value for r in exact_percentiles(df, ["k"], "v", probs).collect()}
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, rel=1e-12, abs=1e-15), key


def test_percentiles_of_large_groups(spark):
    """Groups beyond the size up to which a bracket is the whole group."""
    base = spark.range(120_000).withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1_000_003)))
    kinds = F.when(F.col("id") % 3 == 0, F.floor(F.col("h") / 50_000)).when(F.col("id") % 3 == 1, F.pow(F.col("h"), 3)).otherwise(-F.col("h") / 7)
    df = base.select((F.col("id") % 3).alias("k"), kinds.cast("double").alias("v"))
    probs = [0.0, 0.01, 0.5, 0.95, 0.99, 1.0]
    want = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("v", probs).alias("q")).collect()}
    groups, long = bracketed(df, ["k"], "v", probs, F.max("v").alias("top"))
    got = {(r.k, r.prob): r.value for r in long.collect()}
    assert got == pytest.approx({(k, p): q[i] for k, q in want.items() for i, p in enumerate(probs)}, rel=1e-12)
    assert {r.k: r.top for r in groups.collect()} == {k: q[-1] for k, q in want.items()}


def test_frames_of_a_long_session_are_not_one_task(spark):
    """The blocks are small to read, yet what they are spread into must not be made by one task."""
    dets = spark.createDataFrame([(1, "s", 200_000), (None, "s", 3)], "camera_id BIGINT, session_id STRING, frame_number BIGINT")
    made = inputs.frames(dets)
    per_task = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 200_003 and max(per_task) < 150_000
