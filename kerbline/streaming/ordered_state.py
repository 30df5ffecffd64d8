"""Rows of a key in event-time order, whatever order and batches they arrive in.

Rows wait in the state of their key until the watermark has passed them: Spark drops (and counts) what
arrives behind it, so what is behind it is complete. They lie in buckets of consecutive times; a
bucket that grows beyond ``MOST`` rows is cut in two, new rows of a bucket are entries of their own, and the index of
buckets is small. When a timer fires, the buckets behind the watermark are read one after the other,
sorted and given to the rule. So a task holds one bucket of a key, not all that waits, and a key
costs a few state calls per batch, not per row. Many small keys may share an entry of the state.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
#: The state store that timers and map states need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Rows of a bucket before it is cut, unless all have one time.
MOST = 8192
BEGIN = int(np.iinfo(np.int64).min)


def micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy().astype("datetime64[us]").astype(np.int64)


class _Index:
    """Buckets in order: ``[low, rows, entries, number]``. The first one has no lower end."""

    def __init__(self) -> None:
        self.buckets: list[list[int]] = []
        self.next = 0
        self.first: int | None = None  # the earliest time that waits
        self.due: int | None = None  # the timer that is set, in milliseconds
        self.carry: Any = None

    def add(self, low: int) -> list[int]:
        self.next += 1
        return [low, 0, 0, self.next]


class InTimeOrder(StatefulProcessor):
    """Base of rules that see a key's rows in time order. Subclasses say what they do with them."""

    time: str
    #: Columns that order rows of one time.
    ties: tuple[str, ...] = ()
    #: A key holds several things with times of their own, that :meth:`pruned` takes out one by one.
    several = False

    def wanted(self, carry: Any, rows: pd.DataFrame) -> tuple[Any, pd.DataFrame]:
        """Rows that have to wait, and the carried state that has seen all of them."""
        return carry, rows

    def judge(self, carry: Any, rows: pd.DataFrame) -> tuple[Any, pd.DataFrame | None]:
        """The next rows in order: new carried state, and the output."""
        raise NotImplementedError

    def expires(self, carry: Any) -> int | None:
        """The time in milliseconds from which the carried state matters no more; None: at once."""
        raise NotImplementedError

    def pruned(self, carry: Any, mark: int) -> Any:
        """Carried state without the parts that matter no more from ``mark`` on. For rules whose key holds several things."""
        return carry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._index = handle.getValueState("index", "data binary")
        self._rows = handle.getMapState("rows", "bucket long, entry int", "data binary")

    def close(self) -> None:
        pass

    def _load(self) -> _Index:
        found = self._index.get()
        return _Index() if found is None else pickle.loads(found[0])

    def _store(self, index: _Index, mark: int) -> None:
        """Write the index, or forget the key; set the timer for what comes next."""
        if index.first is None:
            index.carry = self.pruned(index.carry, mark)
            end = self.expires(index.carry)
            if end is None or end <= mark:
                self._index.clear()
                if index.due is not None:
                    self._handle.deleteTimer(index.due)
                return
        else:
            end = index.first // 1000 + 1
            if self.several and (idle := self.expires(index.carry)) is not None:
                end = min(end, idle)
        end = max(end, mark + 1)
        if index.due is None or end < index.due:
            if index.due is not None:
                self._handle.deleteTimer(index.due)
            self._handle.registerTimer(end)
            index.due = end
        self._index.update((pickle.dumps(index, protocol=5),))

    def _put(self, bucket: list[int], rows: pd.DataFrame) -> None:
        self._rows.updateValue((bucket[3], bucket[2]), (pickle.dumps(rows, protocol=5),))
        bucket[1] += len(rows)
        bucket[2] += 1

    def _take(self, bucket: list[int]) -> pd.DataFrame:
        """All rows of a bucket in order; they leave the state."""
        parts = []
        for entry in range(bucket[2]):
            parts.append(pickle.loads(self._rows.getValue((bucket[3], entry))[0]))
            self._rows.removeKey((bucket[3], entry))
        bucket[1] = bucket[2] = 0
        return self._sorted(pd.concat(parts, ignore_index=True))

    def _sorted(self, rows: pd.DataFrame) -> pd.DataFrame:
        keys = [rows[c].to_numpy() for c in reversed(self.ties)]
        keys = [k.astype(str) if k.dtype == object else k for k in keys]
        return rows.iloc[np.lexsort((*keys, micros(rows[self.time])))]

    def _insert(self, index: _Index, rows: pd.DataFrame) -> None:
        at = micros(rows[self.time])
        index.first = int(at.min()) if index.first is None else min(index.first, int(at.min()))
        if not index.buckets:
            index.buckets.append(index.add(BEGIN))
        lows = np.array([b[0] for b in index.buckets], np.int64)
        which = np.searchsorted(lows, at, "right") - 1
        for b in np.unique(which)[::-1].tolist():  # from the last one, as a cut moves later ones
            self._put(index.buckets[b], rows[which == b])
            if index.buckets[b][1] > MOST:
                self._cut(index, b)

    def _cut(self, index: _Index, b: int) -> None:
        bucket = index.buckets[b]
        rows = self._take(bucket)
        at = micros(rows[self.time])
        edges = np.unique(at[MOST // 2 :: MOST // 2])
        edges = edges[edges > at[0]]
        places = [0, *np.searchsorted(at, edges, "left").tolist(), len(at)]
        parts = [bucket, *(index.add(int(low)) for low in edges)]
        for part, lo, hi in zip(parts, places, places[1:], strict=False):
            self._put(part, rows.iloc[lo:hi])
        index.buckets[b : b + 1] = parts

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        index, mark, seen = self._load(), timerValues.getCurrentWatermarkInMs(), False
        for part in rows:
            index.carry, waiting = self.wanted(index.carry, part)
            seen = seen or index.carry is not None
            if len(waiting):
                seen = True
                self._insert(index, waiting)
        if seen:
            self._store(index, mark)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        index, mark = self._load(), timerValues.getCurrentWatermarkInMs()
        index.due = None
        while index.buckets:
            bucket = index.buckets[0]
            if bucket[1] and index.first >= mark * 1000:
                break
            rows = self._take(bucket) if bucket[1] else None
            ready = 0
            if rows is not None:
                ready = int(np.searchsorted(micros(rows[self.time]), mark * 1000, "left"))
                if ready:
                    index.carry, out = self.judge(index.carry, rows.iloc[:ready])
                    if out is not None and len(out):
                        yield out
                if ready < len(rows):
                    self._put(bucket, rows.iloc[ready:])
                    index.first = int(micros(rows[self.time].iloc[ready : ready + 1])[0])
                    break
            index.buckets.pop(0)
            index.first = None
            if index.buckets:  # it begins no earlier than its lower end, and is the first one now
                index.first, index.buckets[0][0] = index.buckets[0][0], BEGIN
        # What waits is not behind the watermark, so nothing that has rows left is taken out.
        index.carry = self.pruned(index.carry, mark)
        self._store(index, mark)


def in_time_order(rows: DataFrame, keys: list[str], rule: InTimeOrder, schema, groups: int | None = None) -> DataFrame:
    """Run the rule on each key of a stream with a watermark on the rule's time. Null keys are keys like others.

    With ``groups``, keys share that many entries of the state: the rule gets the rows of many keys at once and tells them apart by
    the text ``key_name``. That is for many small keys, as each entry costs some calls per batch. It is frozen in the checkpoint.
    """
    # Keys of one text: pandas has no null among whole numbers, and a null is not equal to itself.
    name = F.to_json(F.struct(*keys))
    if groups is None:
        keyed = rows.withColumn("_key", name)
    else:
        keyed = rows.withColumn("key_name", name).withColumn("_key", F.pmod(F.xxhash64("key_name"), F.lit(groups)).cast("string"))
    return keyed.groupBy("_key").transformWithStateInPandas(rule, schema, "append", "eventTime")
