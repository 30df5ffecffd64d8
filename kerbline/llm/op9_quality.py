"""Quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage becomes a vector of shares of
byte classes and word shapes, an encoder layer makes it ``h``, and a gate
``w . (tanh(V h) * sigmoid(U h))`` gives its attention; the softmax-weighted mean of ``h`` is scored.
Only document labels are known, so the attention learns which passages decide.

A bounded sample of labelled documents lies in ``shards`` parts, with all their passages. In each
round every part makes some Adam steps from the common parameters, and their mean is the next common state.

Null text counts as empty; a text without words is one passage of zeros. Null ids keep their row. A text of
any length is read whole, in training too; only a slice of texts is in memory. Every repeated row is scored; for training a
document comes once, with the smallest text of its rows, and one labelled both ways counts as 1.
No labels leave the untrained parameters: a score of 0.5. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.folds import fold, sample
from kerbline.llm.text import Texts, slices, words
from kerbline.session import cut_lineage

PASSAGE = 64
HIDDEN = 16
GATE = 8


@dataclass(frozen=True)
class Training:
    rounds: int = 4
    #: Steps of each part in a round, and documents in a step.
    steps: int = 60
    batch: int = 64
    rate: float = 0.01
    decay: float = 1e-4
    shards: int = 4
    #: Most labelled documents learnt from.
    sample: int = 8192


def _classes() -> np.ndarray:
    """One of eleven classes for each byte."""
    out = np.full(256, 10, np.int64)
    out[128:] = 0
    out[ord("a") : ord("z") + 1] = 1
    out[ord("A") : ord("Z") + 1] = 2
    out[ord("0") : ord("9") + 1] = 3
    out[[32, 9, 11, 12, 13]] = 4
    out[10] = 5
    for k, group in ((6, ".,;:"), (7, "!?"), (8, "|/\\<>=_~^"), (9, "#$%&*@+")):
        out[[ord(c) for c in group]] = k
    return out


CLASSES = _classes()
KINDS = 11
FEATURES = KINDS + 7


def passages(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """``(row, vectors)``: each row of the slice has one passage at least."""
    w = words(texts, lower=True)
    rows = len(texts.offsets) - 1
    place = np.arange(len(w.row)) - w.first[w.row]
    opens = place % PASSAGE == 0
    head = np.flatnonzero(opens)
    number = np.cumsum(opens) - 1
    # A passage reaches to the next one of its row, or to the end of the text.
    begin = w.start[head]
    stop = np.append(begin[1:], len(texts.data))
    stop = np.minimum(stop, texts.offsets[w.row[head] + 1])
    size = np.maximum(stop - begin, 1)
    count = np.diff(np.append(head, len(w.row)))
    x = np.zeros((len(head), FEATURES))
    kind = CLASSES[texts.data]
    for k in range(KINDS):
        total = np.zeros(len(kind) + 1, np.int64)
        np.cumsum(kind == k, out=total[1:])
        x[:, k] = (total[stop] - total[begin]) / size
    if len(head):
        length = (w.end - w.start).astype(float)
        mean = np.add.reduceat(length, head) / count
        x[:, KINDS] = mean / 10
        x[:, KINDS + 1] = np.sqrt(np.maximum(0, np.add.reduceat(length**2, head) / count - mean**2)) / 10
        x[:, KINDS + 2] = np.log1p(count) / 5
        last, start = kind[w.end - 1], kind[w.start]
        x[:, KINDS + 3] = np.add.reduceat((last >= 7).astype(float), head) / count
        x[:, KINDS + 4] = np.add.reduceat((start == 2).astype(float), head) / count
        x[:, KINDS + 5] = np.add.reduceat((length == 1).astype(float), head) / count
        order = np.lexsort((w.code, number))
        code, of = w.code[order], number[order]
        fresh = np.ones(len(code), bool)
        fresh[1:] = (code[1:] != code[:-1]) | (of[1:] != of[:-1])
        x[:, KINDS + 6] = np.bincount(of[fresh], minlength=len(head)) / count
    row = w.row[head]
    bare = np.setdiff1d(np.arange(rows), row)
    row = np.concatenate([row, bare])
    x = np.concatenate([x, np.zeros((len(bare), FEATURES))])
    order = np.argsort(row, kind="stable")
    return row[order], x[order]


def initial() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(9)
    return {
        "mean": np.zeros(FEATURES),
        "scale": np.ones(FEATURES),
        "W": rng.normal(0, 0.3, (FEATURES, HIDDEN)),
        "b": np.zeros(HIDDEN),
        "V": rng.normal(0, 0.3, (HIDDEN, GATE)),
        "U": rng.normal(0, 0.3, (HIDDEN, GATE)),
        "w": rng.normal(0, 0.3, GATE),
        "c": np.zeros(HIDDEN),
        "d": np.zeros(1),
    }


LEARNT = ("W", "b", "V", "U", "w", "c", "d")


def forward(p: dict[str, np.ndarray], x: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Scores of bags; ``head`` is where each begins in ``x``, none is empty."""
    h = np.tanh(((x - p["mean"]) / p["scale"]) @ p["W"] + p["b"])
    t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (t * s) @ p["w"]
    size = np.diff(np.append(head, len(x)))
    a = np.exp(e - np.repeat(np.maximum.reduceat(e, head), size))
    a /= np.repeat(np.add.reduceat(a, head), size)
    z = np.add.reduceat(a[:, None] * h, head)
    score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -35, 35)))
    return score, (h, t, s, a, z, size)


def backward(p: dict[str, np.ndarray], x: np.ndarray, inner: tuple, error: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients; ``error`` is score minus label over the number of bags."""
    h, t, s, a, z, size = inner
    dz = error[:, None] * p["c"]
    spread = np.repeat(dz, size, axis=0)
    de = a * (((h - np.repeat(z, size, axis=0)) * spread).sum(1))
    gate = de[:, None] * p["w"]
    dt, ds = gate * s * (1 - t * t), gate * t * s * (1 - s)
    dh = a[:, None] * spread + dt @ p["V"].T + ds @ p["U"].T
    du = dh * (1 - h * h)
    return {
        "W": ((x - p["mean"]) / p["scale"]).T @ du,
        "b": du.sum(0),
        "V": h.T @ dt,
        "U": h.T @ ds,
        "w": de @ (t * s),
        "c": z.T @ error,
        "d": error.sum(keepdims=True),
    }


def fit_part(p: dict[str, np.ndarray], bags: list[np.ndarray], y: np.ndarray, t: Training, seed: int) -> dict:
    """Adam steps over random batches."""
    p = {k: v.copy() for k, v in p.items()}
    rng = np.random.default_rng(seed)
    m, v = {k: 0 * p[k] for k in LEARNT}, {k: 0 * p[k] for k in LEARNT}
    for step in range(1, t.steps + 1):
        take = rng.choice(len(bags), min(t.batch, len(bags)), replace=False)
        x = np.concatenate([bags[i] for i in take])
        head = np.concatenate([[0], np.cumsum([len(bags[i]) for i in take])[:-1]])
        score, inner = forward(p, x, head)
        g = backward(p, x, inner, (score - y[take]) / len(take))
        for k in LEARNT:
            g[k] = g[k] + t.decay * p[k]
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            p[k] -= t.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return p


def bags_of(texts: list[str]) -> list[np.ndarray]:
    """All passages of each text."""
    out = []
    for t in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])):
        row, x = passages(t)
        out += np.split(x, np.searchsorted(row, np.arange(1, len(t.offsets) - 1)))
    return out


def _pack(p: dict[str, np.ndarray], names: tuple[str, ...]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in names])


def _unpack(flat: np.ndarray, like: dict[str, np.ndarray], names: tuple[str, ...]) -> dict[str, np.ndarray]:
    out, at = dict(like), 0
    for k in names:
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def _moments(part):
    x = np.concatenate(bags_of(part["text"].tolist()))
    return pd.DataFrame({"n": [float(len(x))], "s": [x.sum(0).tolist()], "q": [(x**2).sum(0).tolist()]})


def _steps(state: dict[str, np.ndarray], number: int, t: Training):
    def run(part):
        part = part.sort_values("doc_id")
        bags = bags_of(part["text"].tolist())
        p = fit_part(state, bags, part["y"].to_numpy(float), t, 1000 * number + int(part["shard"].iloc[0]))
        return pd.DataFrame({"n": [float(len(part))], "p": [_pack(p, LEARNT).tolist()]})

    return run


def train(rows: DataFrame, t: Training = Training()) -> dict[str, np.ndarray]:
    """Learn from ``(doc_id, text, y, shard)``, a bounded sample; a row per part comes back."""
    kept = cut_lineage(rows)
    p = initial()
    found = kept.groupBy("shard").applyInPandas(_moments, "n double, s array<double>, q array<double>").toPandas()
    if not len(found):
        return p
    n = found["n"].sum()
    mean = np.stack(found["s"].to_list()).sum(0) / n
    var = np.stack(found["q"].to_list()).sum(0) / n - mean**2
    p |= {"mean": mean, "scale": np.sqrt(np.maximum(var, 1e-6))}
    for number in range(t.rounds):
        found = kept.groupBy("shard").applyInPandas(_steps(p, number, t), "n double, p array<double>").toPandas()
        share = found["n"].to_numpy() / found["n"].sum()
        p = _unpack(share @ np.stack(found["p"].to_list()), p, LEARNT)
    return p


def score(documents: DataFrame, p: dict[str, np.ndarray]) -> DataFrame:
    """``(doc_id, score)`` of every row."""

    def run(batches):
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for texts in slices(batch):
                row, x = passages(texts)
                head = np.searchsorted(row, np.arange(len(texts.offsets) - 1))
                total[texts.rows] = forward(p, x, head)[0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(total)], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def quality(documents: DataFrame, labels: DataFrame, taken: Column | None = None, t: Training = Training()) -> DataFrame:
    """Scores of all documents by a model learnt from the labelled rows that pass ``taken``."""
    rows = sample(documents, labels, "quality", F.lit(True) if taken is None else taken, t.sample, t.shards)
    return score(documents, train(rows, t))


def predicted(of: Column) -> Column:
    return (of >= 0.7).cast("int")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality(docs, labels, fold(F.col("doc_id"), 4) != 2)
    return out.select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", predicted(F.col("score")).alias("predicted")
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier takes for good ones.

    The model learns from the labels of the table's documents. Repeated ids keep all their rows;
    rows without an id are scored by their text like any other.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    t = Training()
    p = train(sample(docs, labels, "quality", fold(F.col("doc_id"), 4) != 2, t.sample, t.shards), t)

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for texts in slices(batch):
                row, x = passages(texts)
                head = np.searchsorted(row, np.arange(len(texts.offsets) - 1))
                keep[texts.rows] = forward(p, x, head)[0] >= 0.7
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
