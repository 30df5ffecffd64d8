"""Run and benchmark summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.operators.ordered import dense_number
from kerbline.operators.percentiles import percentile_columns

COMPONENTS = ("inference_ms", "tracking_ms", "violation_ms", "total_ms")
RESOURCE_COMPONENTS = ("pipeline", "kafka", "spark")


def _component_rows(frame_metrics: DataFrame) -> DataFrame:
    return frame_metrics.unpivot(["run_id"], list(COMPONENTS), "component", "ms")


def latency_summary(frame_metrics: DataFrame) -> DataFrame:
    """Per run and component: mean, percentiles, extremes and population deviation."""
    rows = _component_rows(frame_metrics)
    moments = (
        F.round(F.avg("ms"), 2).alias("mean"),
        F.round(F.min("ms"), 2).alias("min"),
        F.round(F.max("ms"), 2).alias("max"),
        F.round(F.stddev_pop("ms"), 2).alias("stdev"),
    )
    return percentile_columns(rows, ["run_id", "component"], "ms", {"median": 0.5, "p95": 0.95, "p99": 0.99}, 2, *moments)


def throughput_summary(frame_metrics: DataFrame) -> DataFrame:
    """Frame rate statistics per run."""
    moments = (
        F.round(F.avg("fps"), 2).alias("fps_mean"),
        F.round(F.min("fps"), 2).alias("fps_min"),
        F.round(F.max("fps"), 2).alias("fps_max"),
        F.round(F.stddev_pop("fps"), 2).alias("fps_stdev"),
    )
    names = {"fps_median": 0.5, "fps_p5": 0.05, "fps_p95": 0.95}
    return percentile_columns(frame_metrics, ["run_id"], "fps", names, 2, *moments)


def latency_share(frame_metrics: DataFrame) -> DataFrame:
    """Share of each component in the total latency of a run, in percent."""
    parts = list(COMPONENTS[:3])
    sums = frame_metrics.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in COMPONENTS])
    total = F.expr("nullif(total_ms, 0)")
    shares = sums.select("run_id", *[F.round(100.0 * F.col(c) / total, 2).alias(c) for c in parts])
    return shares.unpivot(["run_id"], parts, "component", "share_pct")


def resource_summary(samples: DataFrame) -> DataFrame:
    """Samples, mean and peak per component; a component without samples has zeros."""
    spark = samples.sparkSession
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, RESOURCE_COMPONENTS))).alias("component"))
    stats = samples.groupBy("component").agg(
        F.count("cpu_percent").alias("samples"),
        F.round(F.avg("cpu_percent"), 2).alias("cpu_avg"),
        F.round(F.max("cpu_percent"), 2).alias("cpu_peak"),
        F.round(F.avg("memory_mb"), 2).alias("memory_avg"),
        F.round(F.max("memory_mb"), 2).alias("memory_peak"),
    )
    return listed.join(stats, "component", "left").na.fill(0)


def confidence_bins_pct(events: DataFrame) -> DataFrame:
    """Count and share per 0.1 bin of confidence."""
    counts = events.filter("confidence IS NOT NULL").groupBy(
        (F.floor(F.col("confidence") * 10) / 10).alias("bin")
    ).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("bin", "n", F.round(100.0 * F.col("n") / total, 2).alias("pct"))


def run_summary(frame_metrics: DataFrame, events: DataFrame, stride: int = 1, recent: int = 100) -> DataFrame:
    """Per run: frames, confirmed events, mean rate of the last ``recent`` rows, skipped frames."""
    last = frame_metrics.groupBy("run_id").agg(F.count("*").alias("frames"))
    numbered = dense_number(frame_metrics, ["run_id"], "frame", "_no")
    tail = numbered.join(last, "run_id").filter(F.col("_no") > F.col("frames") - recent)
    rate = tail.groupBy("run_id").agg(F.round(F.avg("fps"), 1).alias("avg_fps"))
    found = events.groupBy("run_id").agg(F.count("*").alias("violations"))
    return (
        last.join(rate, "run_id")
        .join(found, "run_id", "left")
        .select(
            "run_id",
            "frames",
            F.coalesce("violations", F.lit(0)).alias("violations"),
            "avg_fps",
            (F.col("frames") * (stride - 1)).alias("skipped_frames"),
        )
    )


def ingest_rate(send_log: DataFrame) -> DataFrame:
    """Messages, duration, rate and per-message latency of each send run.

    ``send_log(run_id, sent_at, latency_ms)``.
    """
    seconds = (F.unix_micros(F.max("sent_at")) - F.unix_micros(F.min("sent_at"))) / 1e6
    totals = (
        F.count("*").alias("messages"),
        F.round(seconds, 3).alias("total_seconds"),
        F.round(F.when(seconds > 0, F.count("*") / seconds), 6).alias("messages_per_second"),
        F.round(F.avg("latency_ms"), 3).alias("mean"),
    )
    names = {"median": 0.5, "p95": 0.95, "p99": 0.99}
    return percentile_columns(send_log, ["run_id"], "latency_ms", names, 3, *totals)
