"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed unigrams, bigrams and one-word skip-grams of its
lower-cased words (ASCII letters, digits and all non-ASCII bytes), and the unigrams of the words'
first ``STEM`` bytes, so that inflected forms share what is learnt. A bounded sample of labelled
documents lies in ``shards`` parts. In each round every part runs FTRL over its documents from the
common state and returns what its coordinates changed by; a coordinate takes the mean change of the
parts that met it.
State and weights have ``DIMENSIONS`` entries at most, whatever the corpus; L1 leaves few of them,
and those are broadcast to score all texts.

Null text counts as empty; an empty text has the score of the bias. Null ids keep their row. Texts of any length are
read whole. Every repeated row is scored; for training a document comes once, with the smallest text of its rows, and
one labelled both ways counts as 1.
An empty corpus or no labels give scores of 0.5. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.folds import fold, sample
from kerbline.llm.text import NOT_ALNUM, Prefix, Texts, grams, mix, slices, words
from kerbline.session import cut_lineage

BITS = 18
STEM = 7
DIMENSIONS = 1 << BITS


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 1.5
    l2: float = 1.0
    rounds: int = 5
    #: Passes over its part that a round makes.
    passes: int = 3
    shards: int = 8
    #: Most labelled documents learnt from.
    sample: int = 8192


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """``(row, feature)``, distinct, by row."""
    prefix = Prefix(texts.data, lower=True)
    w = words(texts, lower=True, breaks=NOT_ALNUM, prefix=prefix)
    code, row = w.code, w.row
    parts = [(row, grams(code, 1, 1))]
    if len(code) > 1:
        two = row[:-1] == row[1:]
        parts.append((row[:-1][two], grams(code, 2, 2)[two]))
    if len(code) > 2:
        skip = row[:-2] == row[2:]
        pair = grams(np.stack([code[:-2], code[2:]], 1).reshape(-1), 2, 3)[::2]
        parts.append((row[:-2][skip], pair[skip]))
    longer = w.end - w.start > STEM
    parts.append((row[longer], mix(prefix.of(w.start[longer], w.start[longer] + STEM) + np.uint64(4))))
    rows = np.concatenate([p[0] for p in parts]).astype(np.int64)
    slots = np.concatenate([p[1] for p in parts]) >> np.uint64(64 - BITS)
    return rows, slots.astype(np.int64)


def weights_of(z: np.ndarray, n: np.ndarray, p: Ftrl) -> np.ndarray:
    """Closed form of the proximal step."""
    return np.where(np.abs(z) <= p.l1, 0.0, -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))


def documents_of(texts: list[str]) -> list[np.ndarray]:
    """Distinct features of each text; the first entry is the bias."""
    found = []
    for t in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])):
        row, slot = features(t)
        key = np.unique((row << BITS) | slot)
        cuts = np.searchsorted(key, np.arange(1, t.rows.stop - t.rows.start) << BITS)
        found += [np.concatenate([[DIMENSIONS], x & (DIMENSIONS - 1)]) for x in np.split(key, cuts)]
    return found


def pass_over(found: list[np.ndarray], ys: list[int], z: np.ndarray, n: np.ndarray, p: Ftrl) -> None:
    """One FTRL pass; ``z`` and ``n`` change in place. The bias has no L1."""
    for slots, y in zip(found, ys, strict=True):
        w = weights_of(z[slots], n[slots], p)
        w[0] = -z[DIMENSIONS] / ((p.beta + math.sqrt(n[DIMENSIONS])) / p.alpha + p.l2)
        g = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum()))))) - y
        z[slots] += g - (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / p.alpha * w
        n[slots] += g * g


@dataclass(frozen=True)
class Model:
    slots: np.ndarray
    weights: np.ndarray
    bias: float


def _learner(state, params: Ftrl):
    """What one part changes in the state."""

    def learn(part):
        part = part.sort_values("doc_id")
        z0, n0 = state.value
        z, n = z0.copy(), n0.copy()
        found, ys = documents_of(part["text"].tolist()), part["y"].tolist()
        for _ in range(params.passes):
            pass_over(found, ys, z, n, params)
        changed = np.flatnonzero((z != z0) | (n != n0))
        return pd.DataFrame({"slot": changed, "dz": (z - z0)[changed], "dn": (n - n0)[changed]})

    return learn


def train(rows: DataFrame, params: Ftrl = Ftrl()) -> Model:
    """Learn from ``(doc_id, text, y, shard)``, a bounded sample."""
    spark = rows.sparkSession
    kept = cut_lineage(rows)
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    for _ in range(params.rounds):
        state = spark.sparkContext.broadcast((z, n))
        parts = kept.groupBy("shard").applyInPandas(_learner(state, params), "slot long, dz double, dn double")
        # At most DIMENSIONS + 1 rows, however large the corpus.
        change = parts.groupBy("slot").agg(F.avg("dz").alias("dz"), F.avg("dn").alias("dn")).toPandas()
        z, n = z.copy(), n.copy()
        z[change["slot"]] += change["dz"]
        n[change["slot"]] += change["dn"]
        state.unpersist()
    w = weights_of(z[:-1], n[:-1], params)
    slots = np.flatnonzero(w)
    bias = -z[-1] / ((params.beta + math.sqrt(n[-1])) / params.alpha + params.l2)
    return Model(slots, w[slots], float(bias))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        dense = np.zeros(DIMENSIONS)
        dense[m.slots] = m.weights
        for batch in batches:
            total = np.full(batch.num_rows, m.bias)
            for texts in slices(batch):
                row, slot = features(texts)
                hit = dense[slot] != 0
                key = np.unique((row[hit] << BITS) | slot[hit])
                np.add.at(total, texts.rows.start + (key >> BITS), dense[key & (DIMENSIONS - 1)])
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(p)], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def toxicity(documents: DataFrame, labels: DataFrame, taken: Column | None = None, params: Ftrl = Ftrl()) -> DataFrame:
    """Scores of all documents by a model learnt from the labelled rows that pass ``taken``."""
    rows = sample(documents, labels, "toxic", F.lit(True) if taken is None else taken, params.sample, params.shards)
    return score(documents, train(rows, params))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = toxicity(docs, labels, fold(F.col("doc_id"), 5) != 0)
    return out.select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
