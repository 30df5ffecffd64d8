"""Parallel sorting by regular sampling, for ranks and running totals over tables of any size.

Every partition sorts its own rows: a run. Rows at regular places of the runs, ``SAMPLES`` of them and one
a run at most beside, go to the driver; regular places of those are the splitters. Rows between two splitters
are a segment; it is exchanged to one task and put in order there, and totals of the earlier segments tell
where it begins. The place of a row in its run is the last sort key, so equal rows are cut
apart as well and no segment grows with a hot key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.session import cut_lineage

#: Sampled rows in the driver, and rows that a segment has on average.
SAMPLES, SEGMENT = 1 << 15, 1 << 18
#: Bits of a run's row numbers below the number of the run.
RUN_BITS = 33


def sorted_runs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows, written in locally sorted runs, with their place ``tie``. Keys are non-null longs."""
    return cut_lineage(rows.sortWithinPartitions(*keys).withColumn("tie", F.monotonically_increasing_id()))


def _at(columns: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """Number of splitters that are not after each row, by binary search over all keys at once."""
    low = np.zeros(len(columns[0]), np.int64)
    high = np.full(len(low), len(splitters[0]), np.int64)
    while (low < high).any():
        middle = (low + high) // 2
        probe = np.minimum(middle, len(splitters[0]) - 1)
        # The first key that differs decides; equal rows count the splitter.
        after = np.zeros(len(low), bool)
        for own, cut in zip(reversed(columns), reversed(splitters), strict=True):
            after = np.where(own == cut[probe], after, own < cut[probe])
        open_ = low < high
        high = np.where(open_ & after, middle, high)
        low = np.where(open_ & ~after, middle + 1, low)
    return low


def segments(runs: DataFrame, keys: list[str], least: int, rows_each: int = SEGMENT) -> tuple[DataFrame, int]:
    """``runs`` with the number of its ``segment``, and the number of rows."""
    rows = runs.count()
    names = [*keys, "tie"]
    wanted = max(least, -(-rows // rows_each))
    step = max(1, rows // SAMPLES)
    place = F.col("tie").bitwiseAND(F.lit((1 << RUN_BITS) - 1))
    sample = runs.filter(place % step == 0).select(*names).toPandas().sort_values(names)
    at = np.unique(np.arange(1, wanted) * len(sample) // wanted)
    splitters = [sample[n].to_numpy(np.int64)[at[at < len(sample)]] for n in names]
    if not len(splitters[0]):
        return runs.withColumn("segment", F.lit(0)), rows

    def cut(batches):
        for batch in batches:
            found = _at([batch.column(n).to_numpy() for n in names], splitters)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.astype(np.int32))], [*batch.schema.names, "segment"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)
    return runs.mapInArrow(cut, f"{schema}, segment int"), rows
