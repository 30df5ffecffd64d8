"""Exact, interpolated percentiles of groups of any size.

The built-in exact percentile keeps all distinct values of a group in one buffer. Here a mergeable
quantile sketch, made in the same pass as the other aggregates of the group, gives two values
between which a wanted rank must lie: its error is bounded by a share of the group. A second pass counts
the values below and, one by one, those between. The rank is then found among these few, level by level: counts
per bucket of the value, the bucket that holds the rank, and only its values at the next, finer level.
So the input is read twice, however many percentiles and rounds there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.session import cut_lineage

BITS = 1 << 12
#: Ranks of the sketch are off by a share of 1 / ACCURACY at most; brackets are three such shares wide on either side.
ACCURACY = 10_000
MARGIN = 3 / ACCURACY
#: Groups of fewer values are their own bracket: a rank of theirs may be as wide as the margin.
SMALL = 2 * ACCURACY


def _magnitude(v: Column) -> Column:
    """A non-decreasing function of |v| > 0 whose unit step is 2^-12 of the value."""
    exponent = F.floor(F.log2(F.abs(v)))
    return (exponent + 1100 + F.abs(v) / F.pow(F.lit(2.0), exponent) - 1) * BITS


def _coarse(v: Column) -> Column:
    step = F.floor(_magnitude(v))
    return F.when(v == 0, F.lit(0)).when(v > 0, step).otherwise(-step).cast("bigint")


def _fine(v: Column) -> Column:
    m = _magnitude(v)
    step = F.floor((m - F.floor(m)) * BITS)
    return F.when(v == 0, F.lit(0)).when(v > 0, step).otherwise(-step).cast("bigint")


def bracketed(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], *others: Column) -> tuple[DataFrame, DataFrame]:
    """Two tables: a row per group with ``others``, and ``(keys..., prob, value)`` with linear
    interpolation between neighbouring ranks.

    NULL values are ignored; keys must not be NULL.
    """
    v = F.col(value).cast("double")
    ends = [min(1.0, max(0.0, p + side * MARGIN)) for p in probs for side in (-1, 1)]
    groups = cut_lineage(
        df.groupBy(*keys).agg(
            *others,
            F.count(v).alias("_n"),
            F.min(v).alias("_least"),
            F.max(v).alias("_most"),
            F.percentile_approx(v, ends, ACCURACY).alias("_ends"),
        )
    )
    small = F.col("_n") < SMALL
    brackets = F.array(
        *[
            F.struct(
                F.lit(float(p)).alias("_p"),
                F.when(small, F.col("_least")).otherwise(F.col("_ends")[2 * i]).alias("_from"),
                F.when(small, F.col("_most")).otherwise(F.col("_ends")[2 * i + 1]).alias("_to"),
            )
            for i, p in enumerate(probs)
        ]
    )
    wanted = groups.filter("_n > 0").select(*keys, "_n", F.inline(brackets))
    met = df.select(*keys, v.alias("_v")).join(wanted.drop("_n"), list(keys)).filter("_v <= _to")
    # Values below a bracket are counted together, under null.
    met = met.select(*keys, "_p", F.when(F.col("_v") >= F.col("_from"), F.col("_v")).alias("_v"))
    counted = cut_lineage(met.groupBy(*keys, "_p", "_v").agg(F.count("*").alias("_c")))
    below = counted.filter("_v IS NULL").select(*keys, "_p", F.col("_c").alias("_below"))
    exact = F.col("_p") * (F.col("_n") - 1)
    ranks = (
        wanted.join(below, [*keys, "_p"], "left")
        .withColumn("_rank", F.explode(F.array(F.floor(exact), F.ceil(exact))))
        .select(
            *keys,
            "_p",
            (F.col("_rank") - F.coalesce("_below", F.lit(0))).alias("_rank"),
            (exact - F.floor(exact)).alias("_weight"),
            (F.col("_rank") == F.floor(exact)).alias("_low"),
        )
        .distinct()
    )
    return groups.drop("_n", "_least", "_most", "_ends"), _located(counted.filter("_v IS NOT NULL"), keys, ranks)


def _located(counted: DataFrame, keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """The values of the wanted ranks among counted values ``(keys..., _p, _v, _c)``."""
    v = F.col("_v")
    rows = counted.withColumns({"_l0": _coarse(v), "_l1": _fine(v)})
    prefix = [*keys, "_p"]
    for level in ("_l0", "_l1", "_v"):
        candidates = rows.join(wanted.select(*prefix).distinct(), prefix, "left_semi")
        counts = candidates.groupBy(*prefix, level).agg(F.sum("_c").alias("_n"))
        ordered = W.partitionBy(*prefix).orderBy(level)
        counts = counts.withColumn("_upto", F.sum("_n").over(ordered.rowsBetween(W.unboundedPreceding, 0)))
        start = F.col("_upto") - F.col("_n")
        wanted = (
            counts.join(wanted, prefix)
            .filter((F.col("_rank") >= start) & (F.col("_rank") < F.col("_upto")))
            .withColumn("_rank", F.col("_rank") - start)
            .select(*prefix, level, "_rank", "_weight", "_low")
            .distinct()
        )
        prefix.append(level)

    low = F.max(F.when(F.col("_low"), v))
    high = F.coalesce(F.max(F.when(~F.col("_low"), v)), low)
    return (
        wanted.groupBy(*keys, F.col("_p").alias("prob"))
        .agg(low.alias("_a"), high.alias("_b"), F.max("_weight").alias("_w"))
        .select(*keys, "prob", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_w")).alias("value"))
    )


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """``(keys..., prob, value)`` alone."""
    return bracketed(df, keys, value, probs)[1]


def percentile_columns(df: DataFrame, keys: Sequence[str], value: str, names: dict[str, float], digits: int, *others: Column) -> DataFrame:
    """``others`` and percentiles as one row per group, percentiles as named, rounded columns."""
    groups, long = bracketed(df, keys, value, sorted(set(names.values())), *others)
    wide = long.groupBy(*keys).agg(
        *[F.round(F.max(F.when(F.col("prob") == float(p), F.col("value"))), digits).alias(n) for n, p in names.items()]
    )
    return groups.join(wide, list(keys))
