"""Importance resampling and regular sampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import op12_resampling as resampling
from kerbline.llm import regular
from tests.llm.helpers import awkward, documents, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def buckets(text, orders):
    w = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(w[k : k + n]) for n in range(1, orders + 1) for k in range(len(w) - n + 1)]
    return len(w), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def brute(rows, target, orders=1, percent=10, least=20, seed=2024):
    own = [(i, *buckets(t, orders)) for i, t in rows]
    s = Counter(b for _, _, bs in own for b in bs)
    t = Counter(b for x in target for b in buckets(x, orders)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * float(all_s + 10_000) / ((s[b] + 1) * float(all_t + 10_000))))
    out = []
    for i, n, bs in own:
        weight = sum(map(gain, bs)) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n >= least])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    ranked = [(*r[:4], k) for k, r in enumerate(order[: percent * len(order) // 100], 1)]
    rest = [(*r[:4], None) for r in order[percent * len(order) // 100 :]] + [(*r[:4], None) for r in out if not r[4]]
    return Counter(ranked + rest)


def cases():
    rng = random.Random(12)
    rows = awkward(rng) + [(20 + k, prose(rng, rng.randrange(5, 60))) for k in range(150)]
    rows += [(500, "hot row " * 15)] * 90 + [(300, "UPPER Case-words_and 123 Ünïcode ÉÀ " * 5), (301, "x" * 100_000 + " tail " * 30)]
    return rows, [prose(rng, 40, 100) for _ in range(20)] + [None, "", "Case words"]


@pytest.mark.parametrize("orders, percent", [(1, 10), (2, 35), (3, 100), (1, 0)])
def test_rows_equal_plain_python(spark, monkeypatch, orders, percent):
    monkeypatch.setattr(regular, "SEGMENT", 7)
    rows, target = cases()
    bench = spark.createDataFrame([(k, t, "z") for k, t in enumerate(target)], "item_id long, text string, rank string")
    got = resampling.resample(documents(spark, rows).repartition(5), bench, percent=percent, orders=orders)
    assert Counter(map(tuple, got.collect())) == brute(rows, target, orders, percent)


def test_empty_tables(spark):
    none = documents(spark, [])
    assert resampling.resample(none, none).count() == 0
    rows = [(k, f"alpha beta {k} " * 10) for k in range(30)]
    got = resampling.resample(documents(spark, rows), none).collect()
    assert Counter(map(tuple, got)) == brute(rows, [])


def test_crc_of_ranges():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    start = rng.integers(0, 2000, 400)
    end = start + rng.integers(0, 900, 400)
    assert resampling.crc32(data, start, end).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end, strict=True)]


def test_segments_are_ordered_and_bounded(spark):
    """A key that holds most rows is cut apart; segments follow each other."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(100))).alias("a"), (F.col("id") % 5).alias("b"))
    runs = regular.sorted_runs(rows.repartition(6), ["a", "b"])
    cut, n = regular.segments(runs, ["a", "b"], 10, 500)
    assert n == 20_000
    by = {}
    for r in cut.collect():
        by.setdefault(r["segment"], []).append((r["a"], r["b"], r["tie"]))
    assert len(by) == 40 and max(map(len, by.values())) < 1000
    ends = [(min(v), max(v)) for _, v in sorted(by.items())]
    assert all(x[1] < y[0] for x, y in zip(ends, ends[1:], strict=False))
