"""Near-duplicates and substring dedup against brute force."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import pytest

from kerbline.llm import lyndon
from kerbline.llm import op5_near_dedup as near
from kerbline.llm import op7_suffixes as suffixes
from kerbline.llm import op8_substrings as substrings
from tests.llm.helpers import awkward, documents, prose

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows):
    own = [(i, shingle_set(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, s) in enumerate(own):
        for j, t in own[:k]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def near_rows(rng):
    """Groups whose members differ by a few words, some of them chains beyond the threshold."""
    rows = awkward(rng)
    for g in range(12):
        words = prose(rng, 80 + 10 * g, 3000).split()
        for m in range(10):
            mine = list(words)
            for _ in range(m):
                mine[rng.randrange(len(mine))] = f"x{rng.randrange(99999)}"
            rows.append((100 + 20 * g + m, " ".join(mine)))
    return rows


def check_near(spark, rows):
    got = near.near_duplicates(documents(spark, rows)).collect()
    want = components(rows)
    assert len(got) == len(rows)
    sizes = collections.Counter((i, len(shingle_set(t))) for i, t in rows)
    assert collections.Counter((r.doc_id, r.n_shingles) for r in got) == sizes
    for r in got:
        assert r.component_id == want.get(r.doc_id)
        assert r.kept == (r.doc_id is None or r.component_id == r.doc_id)


def test_near_duplicates(spark):
    check_near(spark, near_rows(random.Random(1)))


@pytest.mark.parametrize("limits", [(2, 30)])
def test_near_duplicates_of_large_nodes(spark, monkeypatch, limits):
    """Nodes above the limits branch further and lose no link."""
    monkeypatch.setattr(near, "PAIRED", limits[0])
    monkeypatch.setattr(near, "SMALL", limits[1])
    rng = random.Random(2)
    words = prose(rng, 150, 3000).split()
    rows = []
    for i in range(40):
        mine = list(words)
        for _ in range(i % 9):
            mine[rng.randrange(len(mine))] = f"x{rng.randrange(99999)}"
        rows.append((i, " ".join(mine)))
    check_near(spark, rows)


def test_near_duplicates_of_nothing(spark):
    assert near.near_duplicates(documents(spark, [])).count() == 0
    check_near(spark, [(1, None), (2, "a b c d e f")])


def test_near_stage_keeps_columns_and_one_of_each(spark):
    docs = documents(spark, awkward(random.Random(3)))
    out = near.stage(spark, docs, "")
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 7, 9, 10, 12, 13, 14, 15]
    assert ids.count(None) == 2


def removed_words(rows, window=50):
    seen, out = {}, []
    texts = sorted(((i, WORD.findall(t or "")) for i, t in rows if i is not None), key=lambda x: x[0])
    for i, w in texts:
        for k in range(len(w) - window + 1):
            seen.setdefault(tuple(w[k : k + window]), i)
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1 if i is not None else 0):
            if seen[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("limits", [{}, {"HOT": 3000}, {"HOT": 900, "BUFFER": 2000, "BUCKET": 5000}])
def test_substrings(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(substrings, name, value)
    rng = random.Random(4)
    shared = prose(rng, 130)
    rows = awkward(rng) + [(50 + i, prose(rng, rng.randrange(60)) + " " + shared + "\t" + prose(rng, 40)) for i in range(20)]
    rows += [(49 - i, shared + " " + prose(rng, 9)) for i in range(20)] + [(90, shared + " - " + shared), (90, shared)]
    got = substrings.without_repeats(documents(spark, rows).repartition(7)).collect()
    assert collections.Counter(map(tuple, got)) == removed_words(rows)


def test_substrings_of_one_text_many_times(spark):
    """Rows of one id and text cost no more than their number, nor do many ids with one text."""
    text = prose(random.Random(7), 700, 9000)
    for rows in ([(k, text) for k in range(1500)], [(1, text)] * 1500):
        start = time.time()
        got = substrings.without_repeats(documents(spark, [*rows, (9999, "other " + text)])).collect()
        assert time.time() - start < 60
        assert sorted(r.n_removed for r in got if r.doc_id != 9999) == sorted(0 if i == rows[0][0] else 700 for i, _ in rows)
        assert [r.n_removed for r in got if r.doc_id == 9999] == [700]


def test_substrings_of_nothing(spark):
    assert substrings.without_repeats(documents(spark, [])).count() == 0


def removed_bytes(rows, length=400):
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, int)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        hit = np.cumsum(gone[:-1]) > 0
        spans = int(hit[:1].sum() + (hit[1:] & ~hit[:-1]).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~hit])
        out.append((i, len(t), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("limits", [{}, {"HOT": 3000}, {"HOT": 900, "BUFFER": 2000, "BUCKET": 5000, "PIECE": 4000}])
def test_suffixes(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(suffixes, name, value)
    rng = random.Random(5)
    shared = prose(rng, 160)
    solid = "".join(rng.choice("abc") for _ in range(900))
    rows = awkward(rng)[:9] + awkward(rng)[11:]
    rows += [(50 + i, prose(rng, rng.randrange(60)) + shared[i:] + prose(rng, 40)) for i in range(20)]
    rows += [(80, "q" + solid + "r"), (81, solid[:700]), (82, "z" * 1500), (83, "xyz" * 500), (84, "v" + solid[5:406])]
    rows += [(85, "z" * 450 + solid), (86, "yzx" * 140), (87, "once " + prose(rng, 300, 9000))]
    got = suffixes.without_repeats(documents(spark, rows).repartition(7)).collect()
    assert collections.Counter(map(tuple, got)) == removed_bytes(rows)


def test_suffixes_of_one_text_many_times(spark):
    """Rows of one id and text cost no more than their number, nor do many ids with one text."""
    text = prose(random.Random(7), 700, 9000)
    for rows in ([(k, text) for k in range(1500)], [(None, text)] * 1500):
        start = time.time()
        got = suffixes.without_repeats(documents(spark, [*rows, (9999, "other " + text[:2000])])).collect()
        assert time.time() - start < 60
        assert sum(r.n_removed == r.n_bytes == len(text) for r in got) == 1500
        assert [r.n_removed for r in got if r.doc_id == 9999] == [2000]


def test_places_without_a_cut_and_multiplicity():
    rng = np.random.default_rng(2)
    texts = [b"z" * 900, b"zy" * 350, bytes(rng.integers(97, 100, 1200).tolist()), b"ab" + b"z" * 500]
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for copies in ([1, 1, 1, 1], [1, 1, 2, 1], [3, 1, 1, 1]):
        starts = collections.Counter()
        for t, c in zip(texts, copies, strict=True):
            for k in range(len(t) - 399):
                starts[t[k : k + 400]] += c
        want = [k + 400 <= len(t) and starts[t[k : k + 400]] > 1 for t in texts for k in range(len(t))]
        got = suffixes.covered(np.frombuffer(b"".join(texts), np.uint8), begin, np.array(copies))
        assert got.tolist() == want


def test_suffixes_of_nothing(spark):
    assert suffixes.without_repeats(documents(spark, [])).count() == 0


def test_suffix_array():
    rng = random.Random(6)
    for _ in range(3000):
        s = [rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randrange(40))] + [0]
        assert lyndon.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
