"""Which windows of documents op1 embeds."""

import random

import numpy as np
import pyarrow as pa
import pytest

from kerbline.llm import op1_decontamination as leak
from kerbline.llm.text import Texts, words
from tests.llm.helpers import prose


class Shared:
    def __init__(self, value):
        self.value = value


def codes(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return words(Texts(slice(0, 1), data, np.array([0, len(data)])), lower=True).code


def bitmap(pieces):
    cells = np.zeros(1 << (leak.BITMAP - 6), np.uint64)
    for piece in pieces:
        pairs = leak._pairs(codes(piece))
        for bit in np.concatenate([leak._bits_of(pairs, 0), leak._bits_of(pairs, len(piece.split()))]).tolist():
            cells[bit >> 6] |= np.uint64(1 << (bit & 63))
    return cells


def embedded(cells, lengths, texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    rows = [r for b in leak._windows(Shared(cells), lengths)(iter([batch])) for r in b.to_pylist()]
    for r in rows:
        assert np.array(r["words"], np.int64).view(np.uint64).tolist() == codes(texts[r["doc_id"]])[r["start"] :][: r["n"]].tolist()
    return sorted((r["doc_id"], r["start"], r["n"]) for r in rows)


@pytest.mark.parametrize("vocabulary", [4, 30, 900])
def test_windows_with_enough_pairs(vocabulary):
    rng = random.Random(vocabulary)
    pieces = [prose(rng, n, vocabulary) for n in (1, 2, 3, 5, 9, 9, 20, 41)]
    texts = [prose(rng, rng.randrange(120), vocabulary) for _ in range(12)] + [None, "", "one", pieces[0], pieces[1]]
    texts += [f"{prose(rng, 9, vocabulary)} {p} {prose(rng, 9, vocabulary)}" for p in pieces]
    lengths = sorted({len(p.split()) for p in pieces})
    cells = bitmap(pieces)
    want = []
    for d, text in enumerate(texts):
        own = codes(text) if text else np.zeros(0, np.uint64)
        for n in lengths:
            for k in range(len(own) - n + 1):
                pairs = leak._pairs(own[k : k + n])
                there = leak._set(cells, pairs, n) & leak._set(cells, pairs, 0)
                if there.sum() >= (leak._least_pairs(n) if n > 1 else 1):
                    want.append((d, k, n))
    assert embedded(cells, lengths, texts) == sorted(want)
    for n in lengths:
        embedded(cells, [n], texts)


def test_a_bit_of_one_length_alone_is_no_pair():
    """A pair repeated all over a text, whose bit for some length another pair has set."""
    cells = bitmap([])
    bit = int(leak._bits_of(leak._pairs(codes("na na")), 12)[0])
    cells[bit >> 6] |= np.uint64(1 << (bit & 63))
    known = bitmap([prose(random.Random(1), 12, 900)])
    assert embedded(cells | known, [12], ["na " * 60 + prose(random.Random(1), 12, 900)]) == [(0, k, 12) for k in range(56, 61)]


def test_lengths_look_at_known_pairs_only(monkeypatch):
    seen = []
    plain = leak._bits_of
    rng = random.Random(2)
    pieces = [prose(rng, n, 9000) for n in range(15, 60)]
    cells = bitmap(pieces)
    monkeypatch.setattr(leak, "_bits_of", lambda pairs, n: seen.append(len(pairs)) or plain(pairs, n))
    text = prose(rng, 3000, 9000) + " " + pieces[20] + " " + prose(rng, 3000, 9000)
    assert (0, 3000, 35) in embedded(cells, list(range(15, 60)), [text])
    assert sum(seen) < 3 * len(text.split())
