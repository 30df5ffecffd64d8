"""Ordered computations over keys of any size.

A window over one key runs in one task, so a key that holds a third of all rows would
decide the run time. Here every ordered pass is split in chunks of the ordering column:
rows are windowed inside ``(key, chunk)``, each chunk is reduced to one summary row, a
window over the summaries gives what earlier chunks carry in, and an equi-join on
``(key, chunk)`` brings that to the rows. A chunk bounds the rows of a task; the summary
window sees one row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Rows per key and task at most; the summary of a key with n rows has n / CHUNK rows.
CHUNK = 1 << 14
CHUNK_COL = "_chunk"


def chunk_of(order: Column, size: int = CHUNK) -> Column:
    return F.floor(order / F.lit(size)).cast("bigint")


def carry_in(df: DataFrame, keys: Sequence[str], partials: dict[str, Column], folds: dict[str, Column]) -> DataFrame:
    """Join to every row what the earlier chunks of its key carry in.

    ``partials`` are aggregates per ``(key, chunk)``; ``folds`` are expressions over them,
    usually windows made with :func:`before`.
    """
    summary = df.groupBy(*keys, CHUNK_COL).agg(*[e.alias(n) for n, e in partials.items()])
    state = summary.select(*keys, CHUNK_COL, *[e.alias(n) for n, e in folds.items()])
    return df.join(state, [*keys, CHUNK_COL])


def before(keys: Sequence[str]):
    """Window over the chunks before the current one."""
    return W.partitionBy(*keys).orderBy(CHUNK_COL).rowsBetween(W.unboundedPreceding, -1)


def after(keys: Sequence[str]):
    """Window over the chunks after the current one, nearest first."""
    return W.partitionBy(*keys).orderBy(F.col(CHUNK_COL).desc()).rowsBetween(W.unboundedPreceding, -1)


def inside(keys: Sequence[str], *order):
    """Window over the rows of one chunk."""
    return W.partitionBy(*keys, CHUNK_COL).orderBy(*order)


def previous(df: DataFrame, keys: Sequence[str], order: str, columns: dict[str, str], size: int = CHUNK) -> DataFrame:
    """``lag`` of non-null columns over keys of any size. ``columns`` maps result to source.

    ``order`` is a unique integer within a key.
    """
    df = df.withColumn(CHUNK_COL, chunk_of(F.col(order), size))
    fields = F.struct(*[F.col(s).alias(r) for r, s in columns.items()])
    rows = carry_in(
        df,
        keys,
        {"_last": F.max_by(fields, F.col(order))},
        {"_carry": F.last("_last").over(before(keys))},
    )
    lagged = F.lag(fields).over(inside(keys, order))
    rows = rows.withColumn("_prev", F.coalesce(lagged, F.col("_carry")))
    return rows.select(
        *[c for c in df.columns if c != CHUNK_COL],
        *[F.col(f"_prev.{r}").alias(r) for r in columns],
    )


def following(df: DataFrame, keys: Sequence[str], order: str, result: str, size: int = CHUNK) -> DataFrame:
    """``lead(order)`` over keys of any size."""
    df = df.withColumn(CHUNK_COL, chunk_of(F.col(order), size))
    rows = carry_in(
        df,
        keys,
        {"_first": F.min(order)},
        {"_carry": F.last("_first").over(after(keys))},
    )
    lead = F.lead(order).over(inside(keys, order))
    return rows.withColumn(result, F.coalesce(lead, F.col("_carry"))).drop(CHUNK_COL, "_carry")


def running_sum(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, str], size: int = CHUNK) -> DataFrame:
    """Inclusive prefix sums. ``values`` maps result to source; ``order`` is unique per key."""
    df = df.withColumn(CHUNK_COL, chunk_of(F.col(order), size))
    rows = carry_in(
        df,
        keys,
        {f"_s_{r}": F.sum(s) for r, s in values.items()},
        {f"_o_{r}": F.coalesce(F.sum(f"_s_{r}").over(before(keys)), F.lit(0)) for r in values},
    )
    here = inside(keys, order).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({r: F.sum(s).over(here) + F.col(f"_o_{r}") for r, s in values.items()})
    return rows.drop(CHUNK_COL, *[f"_o_{r}" for r in values])


def dense_number(df: DataFrame, keys: Sequence[str], order: str, result: str, size: int = CHUNK) -> DataFrame:
    """``row_number`` over a column that is unique per key."""
    return (
        running_sum(df.withColumn("_one", F.lit(1).cast("bigint")), keys, order, {result: "_one"}, size).drop("_one")
    )


def running_max(df: DataFrame, order: str, value: str, result: str, size: int = 1 << 16) -> DataFrame:
    """Inclusive running maximum over the whole table in ``order``."""
    df = df.withColumn(CHUNK_COL, chunk_of(F.col(order), size))
    # Chunks are summed up in blocks of as many chunks: a window over the chunks of a block sees
    # ``size`` rows at most, and the unkeyed one a row per ``size * size`` values of the order.
    chunks = df.groupBy(CHUNK_COL).agg(F.max(value).alias("_max")).withColumn("_block", chunk_of(F.col(CHUNK_COL), size))
    blocks = chunks.groupBy("_block").agg(F.max("_max").alias("_top"))
    earlier = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.max("_top").over(earlier).alias("_before"))
    in_block = W.partitionBy("_block").orderBy(CHUNK_COL).rowsBetween(W.unboundedPreceding, -1)
    state = chunks.join(blocks, "_block").select(CHUNK_COL, F.greatest(F.max("_max").over(in_block), "_before").alias("_carry"))
    rows = df.join(state, CHUNK_COL)
    here = inside([], order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn(result, F.greatest(F.max(value).over(here), F.col("_carry"))).drop(CHUNK_COL, "_carry")


def with_halo(df: DataFrame, keys: Sequence[str], order: str, depth: int, size: int = CHUNK) -> DataFrame:
    """Prepare ROWS frames of at most ``depth`` earlier rows.

    Rows are numbered per key; each chunk of numbers also gets copies of the ``depth`` rows
    before it (``_halo`` true), so a bounded frame inside the chunk is the frame over the key.
    """
    size = max(size, depth)
    numbered = dense_number(df, keys, order, "_no", size)
    chunk = chunk_of(F.col("_no"), size)
    # Copies go to the next chunk only from the last ``depth`` numbers of a chunk.
    targets = F.when(
        F.col("_no") % size >= size - depth, F.array(chunk, chunk + 1)
    ).otherwise(F.array(chunk))
    return (
        numbered.withColumn(CHUNK_COL, F.explode(targets))
        .withColumn("_halo", F.col(CHUNK_COL) > chunk)
        .drop("_no")
    )
