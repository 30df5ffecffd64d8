"""What goes into the suffix arrays of op7, and that nothing is lost in front of them."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from kerbline.llm import op7_suffixes as suffixes
from tests.llm.helpers import prose


@pytest.fixture
def symbols(monkeypatch):
    """Lengths of the rows of symbols that are put in order."""
    seen = []
    plain = suffixes.suffix_array
    monkeypatch.setattr(suffixes, "suffix_array", lambda s: seen.append(len(s)) or plain(s))
    return seen


def starts_found(texts, parts=3):
    """Covered places of each text by the steps of the tasks, the texts dealt to some senders."""
    rows = []
    for k in range(parts):
        mine = range(k, len(texts), parts)
        batch = pa.RecordBatch.from_arrays([pa.array(list(mine), pa.int64()), pa.array([texts[i] for i in mine], pa.string())], ["mark", "text"])
        rows += suffixes._packed(2, np.zeros(0, np.uint64))(iter([batch]))
    rows.sort(key=lambda r: r.column(0)[0].as_py())
    out = [np.zeros(len(t), bool) for t in texts]
    for batch in suffixes._judged(2)(iter(rows)):
        for r in batch.to_pylist():
            out[r["mark"]][r["lo"] : r["hi"]] = True
    return [o.tolist() for o in out]


def brute(texts):
    size = suffixes.LENGTH
    seen = collections.Counter(t[k : k + size] for t in texts for k in range(len(t) - size + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t), bool)
        for k in range(len(t) - size + 1):
            if seen[t[k : k + size]] > 1:
                hit[k : k + size] = True
        out.append(hit.tolist())
    return out


def test_a_line_in_other_surroundings_gets_no_array(symbols):
    rng = random.Random(3)
    line = prose(rng, 60, 9000)[:300]
    texts = [prose(rng, 150, 9000) + " " + line + " " + prose(rng, 150, 9000) for _ in range(30)]
    assert starts_found(texts) == brute(texts)
    assert not symbols


def test_parts_of_stretches_that_repeat(symbols):
    rng = random.Random(4)
    passage = prose(rng, 400, 9000)
    texts = []
    for k in range(24):
        words = passage.split()
        words[17 * k % 400] = "edited"
        texts.append(prose(rng, 100, 9000) + " " + " ".join(words[5 * k :]) + " " + prose(rng, 100, 9000))
    texts += [passage, passage, "z" * 900, "zy" * 450, "q" + "zy" * 300, "xyz" * 500, passage[100:499], passage[100:500], passage[:399] + "!" + passage[:400]]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randrange(380, 700))) for _ in range(5)] + ["ab" * 150 + passage[:300]] * 2
    assert starts_found(texts) == brute(texts)
    assert symbols


def test_strings_without_a_cut_get_more_cuts_before_all_bytes(symbols):
    rng = random.Random(5)
    texts = []
    while len(texts) < 6:  # 24 bytes again and again, and no cut in them
        text = ("".join(rng.choice("abcdefgh") for _ in range(24)) * 60).encode()
        prints = suffixes.Prefix(np.frombuffer(text, np.uint8)).runs(suffixes.CONTEXT)
        if (prints % np.uint64(suffixes.CHUNK)).all() and not (prints % np.uint64(suffixes.CHUNK // 8)).all():
            texts.append(text)
    data = np.frombuffer(b"".join(texts), np.uint8)
    got = suffixes.covered(data, np.arange(7) * 1440)
    assert got.reshape(6, 1440)[:, :1041].all() and not got.reshape(6, 1440)[:, 1041:].any()
    assert sum(symbols) < len(data)
