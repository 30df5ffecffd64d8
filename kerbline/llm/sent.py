"""Map-side combining of strings that travel as text: what a task has sent, it does not send again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.text import Texts, slices
from kerbline.session import cut_lineage

#: Partitions of an exchange; beyond that each one has several buckets, which come one after the other.
MOST_PARTITIONS = 100_000
#: Strings remembered; beyond that the table starts anew, and a string may be sent again.
MOST = 1 << 20


class Sent:
    """Names of the strings that a task has sent, with columns that belong to the one that stands for each."""

    def __init__(self, columns: int):
        self.names = np.zeros(0, np.uint64)
        self.columns = [np.zeros(0, np.int64) for _ in range(columns)]

    def find(self, names: np.ndarray) -> np.ndarray:
        """The place of each name in the table, -1 where it is not there."""
        if not len(self.names):
            return np.full(len(names), -1)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[at] == names, at, -1)

    def add(self, names: np.ndarray, *columns: np.ndarray) -> None:
        """Names that are not in the table yet."""
        if len(self.names) + len(names) > MOST:
            self.__init__(len(self.columns))
        order = np.argsort(names)
        at = np.searchsorted(self.names, names[order])
        self.names = np.insert(self.names, at, names[order])
        self.columns = [np.insert(old, at, new[order]) for old, new in zip(self.columns, columns, strict=True)]


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the keys, the last one first, and where each run of equal last keys begins and how long it is."""
    order = np.lexsort(keys)
    last = keys[-1][order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = last[1:] != last[:-1]
    head = np.flatnonzero(fresh)
    return order, head, np.diff(np.append(head, len(order)))


def _summed(names: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
    own, place = np.unique(np.concatenate(names), return_inverse=True)
    load = np.bincount(place, np.concatenate(sizes)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(load)], ["m", "n"])


def _loads(minimisers: Callable[[Texts], tuple[np.ndarray, np.ndarray]]):
    """Bytes that travel under each minimiser, and under the null minimiser those of all texts."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        total, names, sizes, held = 0, [], [], 0
        for batch in batches:
            for texts in slices(batch):
                value, size = minimisers(texts)
                total += len(texts.data)
                names.append(value)
                sizes.append(size)
                held += len(value)
            if held > 1 << 20:
                yield _summed(names, sizes)
                names, sizes, held = [], [], 0
        if held:
            yield _summed(names, sizes)
        yield pa.RecordBatch.from_arrays([pa.nulls(1).cast(pa.int64()), pa.array([total], pa.int64())], ["m", "n"])

    return run


def layout(documents: DataFrame, minimisers: Callable, least: int, bucket: int, hot: int, most: int) -> tuple[int, int, np.ndarray]:
    """The number of buckets of ``bucket`` bytes of text, ``least`` or more, of partitions that they lie in, and the minimisers
    with more than ``hot`` bytes, in order.

    All come from all texts. No more than ``most`` minimisers come to the driver: ``hot`` grows once the corpus is larger than
    that many times ``hot``.
    """
    loads = cut_lineage(documents.select("text").mapInArrow(_loads(minimisers), "m long, n long").groupBy("m").agg(F.sum("n").alias("n")))
    sums = loads.agg(F.sum(F.when(F.col("m").isNull(), F.col("n"))).alias("text"), F.sum(F.when(F.col("m").isNotNull(), F.col("n"))).alias("sent")).first()
    limit = max(hot, (sums["sent"] or 0) // most)
    rows = loads.filter(F.col("m").isNotNull() & (F.col("n") > limit)).select("m").collect()
    buckets = max(least, -(-(sums["text"] or 0) // bucket))
    return buckets, min(buckets, MOST_PARTITIONS), np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))
