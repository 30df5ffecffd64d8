"""Batch event deduplication and lateness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.operators.ordered import CHUNK_COL, after, carry_in, chunk_of, inside, previous, running_max
from kerbline.session import cut_lineage

# The key as one value: a null part equals another one, and no join loses it.
KEYS = ("_key",)
PARTS = ("track_id", "camera_id")
HOUR_US = 3_600_000_000


def _successors(times: DataFrame, horizon_us: int) -> DataFrame:
    """For each (key, t) the first t' of the key with t' > t + horizon, or NULL.

    Each time also enters as a probe at t + horizon; walking a key from late to early, the
    event last passed before a probe is its successor. Ties put the probe first, because an
    event exactly at the horizon is still suppressed.
    """
    events = times.select(*KEYS, F.col("t").alias("at"), F.lit(1).alias("is_event"))
    probes = times.select(*KEYS, (F.col("t") + horizon_us).alias("at"), F.lit(0).alias("is_event"))
    both = events.unionByName(probes).withColumn(CHUNK_COL, chunk_of(F.col("at"), HOUR_US))
    passed = F.when(F.col("is_event") == 1, F.col("at"))
    rows = carry_in(
        both,
        KEYS,
        {"_first": F.min(passed)},
        {"_carry": F.last("_first", ignorenulls=True).over(after(KEYS))},
    )
    down = inside(KEYS, F.desc("at"), "is_event").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = rows.withColumn("next_t", F.coalesce(F.last(passed, ignorenulls=True).over(down), F.col("_carry")))
    return found.filter("is_event = 0").select(*KEYS, (F.col("at") - horizon_us).alias("t"), "next_t")


def dedup_batch(events: DataFrame, horizon_seconds: int = 30) -> DataFrame:
    """Keep an event if it is later than the last *kept* event of its key by more than the horizon.

    The rule is sequential, so it is solved by pointers. Every event after a quiet gap longer
    than the horizon is kept for certain. From each of these a chain of "first event after
    the horizon" runs to the next certain one. All chains are walked at once, with pointers
    that double their reach each round: the number of rounds is the logarithm of the longest
    chain, and rows leave the work as soon as their chain has ended. No key is collected
    anywhere. Of events with equal key and time the row with the smallest event id stands for
    all, so a redelivery is one row. Null keys are a key; events without a time cannot be
    placed and all stay.
    """
    horizon = horizon_seconds * 1_000_000
    row = F.struct(*events.columns)
    timed = events.filter(F.col("event_timestamp").isNotNull())
    stamped = timed.select(F.struct(*PARTS).alias("_key"), F.unix_micros("event_timestamp").alias("t"), "event_id", row.alias("row"))
    times = stamped.groupBy(*KEYS, "t").agg(F.coalesce(F.min_by("row", "event_id"), F.first("row")).alias("row"))
    gaps = previous(times.select(*KEYS, "t"), KEYS, "t", {"prev_t": "t"}, HOUR_US)
    quiet = F.col("prev_t").isNull() | (F.col("t") - F.col("prev_t") > horizon)
    state = cut_lineage(gaps.withColumn("certain", quiet))
    certain, doubtful = state.filter("certain"), state.filter("NOT certain")

    # Chains live in runs: a certain event, its doubtful followers, and the certain event
    # that ends the run. Everything else is decided already.
    crowded = doubtful.select(*KEYS, F.col("prev_t").alias("t"))
    leaders = cut_lineage(certain.select(*KEYS, "t").join(crowded, [*KEYS, "t"], "left_semi"))
    members = leaders.unionByName(doubtful.select(*KEYS, "t"))
    ends = certain.join(members.withColumnRenamed("t", "prev_t"), [*KEYS, "prev_t"], "left_semi").select(*KEYS, "t")
    busy = members.unionByName(ends).distinct()
    targets = doubtful.select(*KEYS, F.col("t").alias("next_t"))
    step = cut_lineage(_successors(busy, horizon).join(targets, [*KEYS, "next_t"], "left_semi"))

    reached = leaders
    while not step.isEmpty():
        landed = reached.join(step, [*KEYS, "t"]).select(*KEYS, F.col("next_t").alias("t"))
        reached = cut_lineage(reached.unionByName(landed))
        onward = step.select(*KEYS, F.col("t").alias("next_t"), F.col("next_t").alias("far_t"))
        step = cut_lineage(
            step.join(onward, [*KEYS, "next_t"]).select(*KEYS, "t", F.col("far_t").alias("next_t"))
        )
    kept = certain.select(*KEYS, "t").unionByName(reached)
    chosen = times.join(kept, [*KEYS, "t"], "left_semi").select("row.*")
    return chosen.unionByName(events.filter(F.col("event_timestamp").isNull()))


def late_events(events: DataFrame, arrival: str, delay_seconds: int = 30, chunk: int = 1 << 16) -> DataFrame:
    """Rows that arrive behind the watermark, with their lateness.

    The watermark is the largest event time seen so far in ``arrival`` order minus the delay.
    """
    at = events.withColumn("_us", F.unix_micros("event_timestamp"))
    seen = running_max(at, arrival, "_us", "_seen", chunk)
    behind = F.col("_seen") - delay_seconds * 1_000_000 - F.col("_us")
    return seen.withColumn("late_by_us", behind).filter("late_by_us > 0").drop("_us", "_seen")
