"""Small tables with awkward rows."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mark long, node string, n string, _base int, _place int"


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(spark, rows):
    """``(doc_id, text)`` pairs with further columns, some named like working columns."""
    full = [(i, t, "en", "src0", len(t or ""), 7, "x", "y", 3, 4) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def labels(spark, rows):
    """``(doc_id, quality, toxic)`` with an extra column."""
    return spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, quality int, toxic int, text string")


def awkward(rng: random.Random) -> list[tuple]:
    """Null, empty, short, long and repeated texts, and rows without an id."""
    base = prose(rng, 120)
    words = base.split()
    near = " ".join([*words[:60], "other", *words[61:]])
    long_ = prose(rng, 30_000, 5000)
    return [
        (1, base),
        (2, base),
        (3, near),
        (4, None),
        (5, ""),
        (6, " \t\n "),
        (7, "one"),
        (8, "one"),
        (9, "One two three four"),
        (10, long_),
        (11, "start " + long_ + " end"),
        (12, "ab" * 2000),
        (13, "a " * 700),
        (14, "naïve café " + base[:300] + " 漢字🙂"),
        (2, base),
        (None, base),
        (None, None),
        (15, prose(rng, 200)),
    ]
