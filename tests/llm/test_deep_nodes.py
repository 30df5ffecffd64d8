"""Pairs at the threshold whose nodes go deeper meet with the target probability, through fresh groups of trees."""

import random

import numpy as np

from kerbline.llm import op5_near_dedup as near
from kerbline.llm.text import mix
from tests.llm.helpers import documents, prose
from tests.llm.test_joins import check_near

PAIRS = 1500


def _met(depth, group):
    """Which pairs of sets with a similarity of 0.75 share a node."""
    rng = np.random.default_rng(31)
    code = mix(rng.integers(1, 2**62, (PAIRS, 200)).astype(np.uint64))
    halves = []
    for own in (slice(150, 175), slice(175, 200)):
        mine = np.concatenate([code[:, :150], code[:, own]], axis=1)
        halves.append(np.stack([((mine * k) >> np.uint64(32)).astype(np.uint32).min(1) for k in near._spread(group)], 1))
    roots = mix(np.arange(1, near.TREES + 1, dtype=np.uint64))
    nodes = []
    for mins in halves:
        owner, path = near._descend(mins, np.repeat(np.arange(PAIRS), near.TREES), np.tile(roots, PAIRS), depth)
        nodes.append(set(zip(owner.tolist(), path.tolist(), strict=True)))
    out = np.zeros(PAIRS, bool)
    out[[i for i, _ in nodes[0] & nodes[1]]] = True
    return out


def test_pairs_at_the_threshold_meet_at_every_depth():
    for depth in (near.DEPTH + 2, near.DEPTH + 6, near.DEPTH + 12):
        one = _met(depth, 0)
        assert abs(one.mean() - near.meeting(depth)) < 0.03 and one.mean() < 0.995
        every = one
        for group in range(1, near.groups(depth)):
            every = every | _met(depth, group)
        assert every.mean() >= 0.998
    for depth in range(near.DEPTH + 2, 126, 2):
        assert 1 - (1 - near.meeting(depth)) ** near.groups(depth) >= near.TARGET


def test_deep_classes_get_fresh_tokens(spark, monkeypatch):
    monkeypatch.setattr(near, "PAIRED", 4)
    monkeypatch.setattr(near, "SMALL", 12)
    monkeypatch.setattr(near, "TARGET", 0.98)
    used, sketched = [], near.sketched
    monkeypatch.setattr(near, "sketched", lambda d, group=0: used.append(group) or sketched(d, group))
    rng = random.Random(31)
    template, rows = prose(rng, 120, 10**6).split(), []
    for k in range(40):
        one = template + [f"u{rng.randrange(10**9)}" for _ in range(59)]
        other = list(one)
        for at in rng.sample(range(5, 174, 6), 5):
            other[at] = f"v{rng.randrange(10**9)}"
        rows += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(other))]
    check_near(spark, rows)
    assert used[:2] == [0, 1]


def test_nodes_that_do_not_part_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "PAIRED", 4)
    monkeypatch.setattr(near, "SMALL", 12)
    monkeypatch.setattr(near, "ROUNDS", 0)
    rng = random.Random(32)
    template, rows = prose(rng, 120, 10**6).split(), []
    for k in range(30):
        one = template + [f"u{rng.randrange(10**9)}" for _ in range(50)]
        other = list(one)
        for at in rng.sample(range(5, 165, 8), 4):
            other[at] = f"v{rng.randrange(10**9)}"
        rows += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(other))]
    check_near(spark, rows)
