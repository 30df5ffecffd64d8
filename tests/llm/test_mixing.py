"""The source mix: targets by repeated resharing, the schedule, and what documents give."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from kerbline.llm import op13_mixing as mixing
from kerbline.llm import regular
from tests.llm.helpers import awkward, prose

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, source string, sno long, tie string, target int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 5, "x", 9) for i, t, s in rows], SCHEMA).repartition(6)


def size(text):
    return len(WORD.findall(text or ""))


def targets(rows, mix):
    """Resharing round by round, in exact arithmetic."""
    words = Counter()
    for _, t, s in rows:
        words[s] += size(t)
    weight = {s: mix.weights[k % len(mix.weights)] for k, s in enumerate(sorted(words, key=lambda s: (s is None, s or "")))}
    left, open_, out = Fraction(mix.volume) * sum(words.values()), set(words), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > mix.repeats * words[s]}
        if not above:
            return words, out | share
        for s in above:
            out[s] = Fraction(mix.repeats * words[s])
            left -= out[s]
        open_ -= above
    return words, out


def cases(kind):
    rng = random.Random(kind)
    if kind == "awkward":
        return [(i, t, rng.choice(["b", "a", None, "", "Ω"])) for i, t in awkward(rng)] + [(900, None, "silent"), (901, "", "silent")]
    if kind == "many sources":
        return [(k, prose(rng, rng.randrange(40)), f"s{k % 97}") for k in range(600)]
    if kind == "one row often":
        return [(7, prose(random.Random(1), 30), "hot")] * 300 + [(k, prose(rng, 25), "ab"[k % 2]) for k in range(100)]
    return [(k, prose(rng, rng.randrange(1, 300)), "hot" if k % 3 else f"s{k % 11}") for k in range(400)]


SMALL, ONCE, WHOLE = mixing.Mix(block=16), mixing.Mix(weights=(3, 1), volume=0.8, repeats=1, block=7), mixing.Mix(volume=2.5, repeats=3)


@pytest.mark.parametrize(
    ("kind", "mix"),
    [("awkward", SMALL), ("awkward", WHOLE), ("many sources", SMALL), ("many sources", ONCE), ("one row often", SMALL), ("hot source", ONCE)],
)
def test_taken_words(spark, monkeypatch, kind, mix):
    monkeypatch.setattr(regular, "SEGMENT", 40)
    monkeypatch.setattr(mixing, "CHUNK", 9)
    rows = cases(kind)
    words, want = targets(rows, mix)
    got = mixing.taken(table(spark, rows), mix).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    pairs = {(words[s], round(float(want[s]), 6)) for s in words}
    assert {(r["source_size"], round(r["target"], 6)) for r in got} == pairs
    assert all(0 <= r["taken"] <= mix.repeats * r["size"] for r in got)
    if kind == "one row often":
        assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.taken(table(spark, rows).repartition(3), mix).collect()))
    assert sum(r["taken"] for r in got) == sum(int(t) for t in want.values())


def test_mix_is_even_and_repeats_whole_passes(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 32)
    rows, mix = cases("hot source"), mixing.Mix(block=16)
    words, want = targets(rows, mix)
    got = mixing.mixed(table(spark, rows), mix).collect()
    total, by = Counter(), defaultdict(list)
    for r in got:
        total[r["source"]] += r["to_word"] - r["from_word"]
        by[r["doc_id"], r["pass"]].append((r["from_word"], r["to_word"]))
    assert total == {s: int(t) for s, t in want.items() if int(t)}
    for (_, n), spans in by.items():
        spans.sort()
        assert n < 2 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    slots = {r["slot"]: r["source"] for r in got}
    order = [slots[k] for k in sorted(slots)]
    share = Counter(order)
    for s, n in share.items():  # every start of the mix holds a source's share of it
        seen = 0
        for k, x in enumerate(order, 1):
            seen += x == s
            assert abs(seen - k * n / len(order)) < 6


def test_empty_table(spark):
    assert mixing.taken(table(spark, [])).count() == 0
    assert mixing.mixed(table(spark, [(1, None, "a")])).count() == 0
