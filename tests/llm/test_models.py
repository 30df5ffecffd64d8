"""Learnt scores and nearest neighbours: held-out accuracy, recall, awkward rows."""

import random
import zlib

import numpy as np
import pytest

from kerbline.llm import folds
from kerbline.llm import op4_toxicity as toxicity
from kerbline.llm import op9_quality as quality
from kerbline.llm import op10_neighbours as near
from pyspark.sql import functions as F
from tests.llm.helpers import awkward, documents, labels


def held(i, parts):
    return zlib.crc32(str(i).encode()) % parts


def test_fold_is_crc32_of_the_id(spark):
    rows = spark.range(200).select("id", folds.fold(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == held(r.id, 5) for r in rows)


@pytest.mark.parametrize(
    ("module", "label", "parts", "rest", "size", "accuracy"),
    [(toxicity, "toxic", 5, 0, "0.1", 0.93), (quality, "quality", 4, 2, "0.01", 0.95)],
)
def test_scores_of_held_out_rows(spark, module, label, parts, rest, size, accuracy):
    sf = f"/root/testdata/sf{size}"
    got = module.query(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(r.held_out == (held(r.doc_id, parts) == rest) and 0 <= r.score <= 1 for r in got)
    right = [r.predicted == known[r.doc_id] for r in got if r.held_out and r.doc_id in known]
    assert np.mean(right) >= accuracy


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_of_awkward_rows(spark, module):
    rows = awkward(random.Random(1))
    run = module.toxicity if module is toxicity else module.quality
    known = labels(spark, [(1, 1, 1), (1, 1, 1), (3, 0, 0), (9, None, None), (None, 1, 1), (999, 1, 1), (7, 1, 0), (15, 0, 1)])
    got = run(documents(spark, rows), known).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (4, 5)}) == 1
    none = run(documents(spark, rows), known.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert run(documents(spark, []), known).count() == 0


def test_quality_stage_keeps_the_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("score", F.lit("x"))
    out = quality.stage(spark, docs, sf)
    assert out.schema == docs.schema and 0 < out.count() < docs.count()


def brute(rows, k, every):
    own = {}
    for i, v in rows:
        if i is None or v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        own.setdefault(i, np.array(v, float))
    out = {}
    for i, q in own.items():
        if i % every == 0:
            found = [(-(q * v).sum() / np.sqrt((q * q).sum()) / np.sqrt((v * v).sum()), j) for j, v in own.items() if j != i and len(v) == len(q)]
            out[i] = sorted(found)[:k]
    return out


def compare(spark, rows, least, every=10):
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, region string")
    got = {}
    for r in near.neighbours(table, F.col("vec_id") % every == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    want = brute(rows, 5, every)
    assert set(got) == {q for q, w in want.items() if w}
    hit = 0
    for q, w in want.items():
        mine = got.get(q, [])
        assert [r.rank for r in mine] == list(range(1, len(w) + 1))
        hit += len({r.vec_id for r in mine} & {j for _, j in w})
    assert hit >= least * sum(map(len, want.values()))
    return got, want


def test_neighbours_recall_over_regions(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 300)
    monkeypatch.setattr(near, "ASKED", 40)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    rows = [(i, (centres[i % 12] + 0.6 * rng.normal(size=24)).tolist()) for i in range(2000)]
    compare(spark, rows, 0.95)


def test_neighbours_of_each_length(spark, monkeypatch):
    """The smaller lengths are searched like the most frequent one."""
    monkeypatch.setattr(near, "BLOCK", 50)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=(6, 6, 6, 9, 2)[i % 5]).tolist()) for i in range(900)] + [(1000, [1.0]), (1001, [-1.0]), (1010, [1.0] * 40)]
    got, _ = compare(spark, rows, 0.97)
    assert {3, 4} <= {q % 5 for q in got} or len(got) > 80
    assert [r.vec_id for r in got[1000]] == [1001] and 1010 not in got


def test_neighbours_of_awkward_rows(spark):
    rng = np.random.default_rng(4)
    same = rng.normal(size=8).tolist()
    rows = [(i, same) for i in range(60)] + [(100 + i, rng.normal(size=8).tolist()) for i in range(30)]
    rows += [(200, None), (210, [0.0] * 8), (220, [1.0, None] + [0.0] * 6), (230, [float("nan")] * 8), (None, same), (240, []), (10, same)]
    got, _ = compare(spark, rows, 1.0)
    assert [r.vec_id for r in got[50]] == [0, 1, 2, 3, 4]
    compare(spark, rows[:3], 1.0)
    assert near.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_attention_gradients_by_finite_differences():
    rng = np.random.default_rng(5)
    p = quality.initial() | {"mean": rng.normal(size=quality.FEATURES), "scale": rng.uniform(0.5, 2, quality.FEATURES)}
    x, head, y = rng.normal(size=(11, quality.FEATURES)), np.array([0, 1, 4, 9]), np.array([1.0, 0, 0, 1])
    p["d"][0] = 0.3

    def loss(q):
        s = quality.forward(q, x, head)[0]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    score, inner = quality.forward(p, x, head)
    found = quality.backward(p, x, inner, (score - y) / len(y))
    for name in quality.LEARNT:
        for at in np.ndindex(p[name].shape):
            up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
            up[name][at] += 1e-6
            down[name][at] -= 1e-6
            assert found[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-7)


def test_training_reads_every_passage(spark):
    text = " ".join(f"w{k}" for k in range(64 * 50))
    assert [len(b) for b in quality.bags_of([text, "", "one"])] == [50, 1, 1]


def test_sample_is_bounded_and_repeatable(spark):
    rows = [(k, f"text {k}", "x") for k in range(300)] + [(7, "a smaller text", "x"), (7, "text 7", "x"), (None, "t", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    marks = spark.createDataFrame([(k, k % 2) for k in range(0, 400)] + [(7, 0), (8, None), (8, 1), (None, 1)], "doc_id long, quality int")
    found = folds.sample(docs.repartition(3), marks, "quality", F.col("doc_id") % 3 > 0, 50, 4).collect()
    again = folds.sample(docs.repartition(5), marks, "quality", F.col("doc_id") % 3 > 0, 50, 4).collect()
    assert len(found) == 50 and sorted(found) == sorted(again) and all(r.doc_id % 3 and r.doc_id < 300 for r in found)
    whole = {r.doc_id: r for r in folds.sample(docs, marks, "quality", F.lit(True), 1000, 4).collect()}
    assert len(whole) == 300 and whole[7].text == "a smaller text" and whole[7].y == 1 and whole[8].y == 1


def test_ftrl_steps_equal_the_plain_rule():
    """One coordinate at a time, as the method is written down."""
    rng = random.Random(8)
    p = toxicity.Ftrl(l1=0.4)
    docs = [np.unique(np.array([rng.randrange(40) for _ in range(8)])) for _ in range(120)]
    found, ys = [np.concatenate([[toxicity.DIMENSIONS], d]) for d in docs], [rng.randrange(2) for _ in docs]
    z, n = np.zeros(toxicity.DIMENSIONS + 1), np.zeros(toxicity.DIMENSIONS + 1)
    toxicity.pass_over(found, ys, z, n, p)
    plain_z, plain_n = {}, {}
    for slots, y in zip(found, ys, strict=True):
        w = {}
        for i in slots.tolist():
            zi, l1 = plain_z.get(i, 0.0), 0.0 if i == toxicity.DIMENSIONS else p.l1
            step = (p.beta + plain_n.get(i, 0.0) ** 0.5) / p.alpha + p.l2
            w[i] = 0.0 if abs(zi) <= l1 else -(zi - (l1 if zi > 0 else -l1)) / step
        g = 1 / (1 + np.exp(-sum(w.values()))) - y
        for i in w:
            before = plain_n.get(i, 0.0)
            sigma = ((before + g * g) ** 0.5 - before**0.5) / p.alpha
            plain_z[i] = plain_z.get(i, 0.0) + g - sigma * w[i]
            plain_n[i] = before + g * g
    for i, want in plain_z.items():
        assert z[i] == pytest.approx(want, abs=1e-9) and n[i] == pytest.approx(plain_n[i], abs=1e-9)
    weights = toxicity.weights_of(z[:-1], n[:-1], p)
    assert 0 < np.count_nonzero(weights) < 40
