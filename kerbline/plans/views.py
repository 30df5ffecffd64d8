"""Dashboard views over the fact table.

Each view is one pass: group by the fact's own keys first, then join the (much smaller)
aggregate to the dimensions. Output column names are the dashboard's fixed names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.functions.labels import NO_RISK, RISK, SEVERITY, band, choose

# Weekday columns of the heat map, Monday first (day_of_week 1 = Sunday).
WEEKDAYS = (("Senin", 2), ("Selasa", 3), ("Rabu", 4), ("Kamis", 5), ("Jumat", 6), ("Sabtu", 7), ("Minggu", 1))
# Time period columns, confidence buckets, status steps of the panels.
PERIOD_COLUMNS = (("Pagi", "pagi"), ("Siang", "siang"), ("Sore", "sore"), ("Malam", "malam"))
CONFIDENCE_STEPS = ((0.6, "0.6-0.7"), (0.7, "0.7-0.8"), (0.8, "0.8-0.9"), (0.9, "0.9-1.0"))
LOWEST_CONFIDENCE = "0.5-0.6"
KPI_BANDS = {
    "violations_today": ("green", ((10, "yellow"), (50, "red"))),
    "avg_confidence": ("red", ((0.7, "yellow"), (0.9, "green"))),
    "avg_latency_ms": ("green", ((500, "yellow"), (1000, "red"))),
}
HEATMAP_BANDS = ((1, "#2d6a4f"), (5, "#74c69d"), (10, "#f9c74f"), (20, "#f8961e"), (30, "#e63946"))
HEATMAP_BASE = "#1a1a2e"
HOURLY_BANDS = ((5, "light-blue"), (20, "blue"), (50, "semi-dark-blue"), (200, "dark-red"))
HOURLY_BASE = "super-light-blue"

CONF, LATENCY, AT = "confidence", "processing_latency_ms", "created_at"


def _sums():
    """Partial aggregates from which counts and means can be regrouped."""
    return [
        F.count("*").alias("n"),
        F.sum(CONF).alias("conf_sum"),
        F.count(CONF).alias("conf_n"),
        F.sum(LATENCY).alias("lat_sum"),
        F.count(LATENCY).alias("lat_n"),
        F.min(AT).alias("first_at"),
        F.max(AT).alias("last_at"),
    ]


def _resum():
    return [
        F.sum("n").alias("n"),
        F.sum("conf_sum").alias("conf_sum"),
        F.sum("conf_n").alias("conf_n"),
        F.sum("lat_sum").alias("lat_sum"),
        F.sum("lat_n").alias("lat_n"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
    ]


def _mean(prefix):
    """Mean from a carried sum and count."""
    return F.when(F.col(f"{prefix}_n") > 0, F.col(f"{prefix}_sum") / F.col(f"{prefix}_n"))


def _hours(fact: DataFrame) -> DataFrame:
    return fact.sparkSession.range(0, 24, 1, 1).select(F.col("id").cast("int").alias("hour"))


def kpi_summary(fact: DataFrame, as_of: str) -> DataFrame:
    """Today's figures with the all-time means as fallback. Always one row."""
    today = F.col("date") == F.lit(as_of).cast("date")
    conf, latency = F.when(today, F.col(CONF)), F.when(today, F.col(LATENCY))
    return fact.agg(
        F.count_if(today).alias("violations_today"),
        F.coalesce(F.avg(conf), F.avg(CONF)).alias("avg_confidence"),
        F.coalesce(F.avg(latency), F.avg(LATENCY)).alias("avg_latency_ms"),
        F.count("*").alias("total_violations_alltime"),
        F.max(F.when(today, F.col(AT))).alias("last_violation_time"),
    )


def daily_trend(fact: DataFrame) -> DataFrame:
    return (
        fact.groupBy(F.col("date").alias("time"))
        .agg(
            F.count("*").alias("violations"),
            F.round(F.avg(CONF), 3).alias("avg_confidence"),
            F.round(F.avg(LATENCY), 1).alias("avg_latency_ms"),
        )
        .orderBy("time")
    )


def camera_stats(fact: DataFrame, cameras: DataFrame) -> DataFrame:
    """Facts per camera; facts of unknown cameras form one NULL group."""
    per_key = fact.groupBy("camera_fk").agg(*_sums())
    named = per_key.join(cameras, per_key.camera_fk == cameras.camera_pk, "left")
    return (
        named.groupBy("camera_id", "camera_name", "location_description")
        .agg(*_resum())
        .select(
            "camera_id",
            F.coalesce("camera_name", "camera_id").alias("camera_name"),
            F.coalesce("location_description", F.lit("-")).alias("location"),
            F.col("n").alias("total_violations"),
            F.round(_mean("conf"), 3).alias("avg_confidence"),
            F.round(_mean("lat"), 1).alias("avg_latency_ms"),
            F.col("first_at").alias("first_violation"),
            F.col("last_at").alias("last_violation"),
        )
        .orderBy(F.desc("total_violations"))
    )


def peak_hours(fact: DataFrame) -> DataFrame:
    return (
        fact.groupBy("day_of_week", "hour")
        .agg(F.count("*").alias("violation_count"), F.avg(CONF).alias("avg_confidence"))
        .orderBy("day_of_week", "hour")
    )


def heatmap_hour_day(fact: DataFrame) -> DataFrame:
    """24 hours by 7 weekdays, zero filled."""
    days = [F.count_if(F.col("day_of_week") == d).alias(name) for name, d in WEEKDAYS]
    grid = fact.groupBy("hour").agg(*days)
    return (
        _hours(fact)
        .join(grid, "hour", "left")
        .na.fill(0, [name for name, _ in WEEKDAYS])
        .withColumnRenamed("hour", "Jam")
        .orderBy("Jam")
    )


def time_period_distribution(fact: DataFrame) -> DataFrame:
    return fact.agg(*[F.count_if(F.col("time_period") == p).alias(name) for name, p in PERIOD_COLUMNS])


def hourly_bar(fact: DataFrame) -> DataFrame:
    """24 bars labelled ``HH:00``, zero filled."""
    per_hour = fact.groupBy("hour").agg(F.count("*").alias("n"), F.avg(CONF).alias("conf"))
    return (
        _hours(fact)
        .join(per_hour, "hour", "left")
        .orderBy("hour")
        .select(
            F.concat(F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit(":00")).alias("Jam"),
            F.coalesce("n", F.lit(0)).alias("Pelanggaran"),
            F.coalesce(F.round("conf", 3), F.lit(0.0)).alias("Avg Confidence"),
        )
    )


def confidence_distribution(fact: DataFrame) -> DataFrame:
    """Five fixed buckets; everything below 0.6, NULL included, is in the lowest."""
    bucket = F.coalesce(band(F.col(CONF), LOWEST_CONFIDENCE, CONFIDENCE_STEPS), F.lit(LOWEST_CONFIDENCE))
    counts = fact.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    labels = [LOWEST_CONFIDENCE] + [label for _, label in CONFIDENCE_STEPS]
    ranges = fact.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias("bucket"))
    return (
        ranges.join(counts, "bucket", "left")
        .select(F.col("bucket").alias("Range Confidence"), F.coalesce("n", F.lit(0)).alias("Jumlah"))
        .orderBy("Range Confidence")
    )


def recent_violations(fact: DataFrame, cameras: DataFrame, types: DataFrame, limit: int = 100) -> DataFrame:
    """Latest facts with names. The top-k is taken before the joins; ties go by key."""
    latest = fact.orderBy(F.desc(AT), F.desc("violation_pk")).limit(limit)
    return (
        latest.join(cameras, latest.camera_fk == cameras.camera_pk, "left")
        .join(types, latest.violation_type_fk == types.type_pk, "left")
        .orderBy(F.desc(AT), F.desc("violation_pk"))
        .select(
            F.col(AT).alias("Waktu"),
            F.col("camera_id").alias("Camera ID"),
            F.coalesce("camera_name", "camera_id").alias("Kamera"),
            F.coalesce("location_description", F.lit("-")).alias("Lokasi"),
            F.coalesce("type_name", F.lit("-")).alias("Tipe"),
            F.round(CONF, 3).alias("Confidence"),
            F.col("track_id").alias("Track ID"),
            F.round(LATENCY, 1).alias("Latency (ms)"),
            F.col("time_period").alias("Periode"),
            F.col("hour").alias("Jam"),
        )
    )


def hourly_violations(fact: DataFrame, cameras: DataFrame) -> DataFrame:
    per_key = fact.groupBy("date", "hour", "day_of_week", "time_period", "camera_fk").agg(*_sums())
    named = per_key.join(cameras.select("camera_pk", "camera_id"), per_key.camera_fk == F.col("camera_pk"), "left")
    return (
        named.groupBy("date", "hour", "day_of_week", "time_period", "camera_id")
        .agg(*_resum())
        .select(
            "date",
            "hour",
            "day_of_week",
            "time_period",
            "camera_id",
            F.col("n").alias("violation_count"),
            _mean("conf").alias("avg_confidence"),
            _mean("lat").alias("avg_latency_ms"),
        )
    )


def today_summary(fact: DataFrame, as_of: str) -> DataFrame:
    return fact.filter(F.col("date") == F.lit(as_of).cast("date")).agg(
        F.count("*").alias("total_violations_today"),
        F.avg(CONF).alias("avg_confidence_today"),
        F.avg(LATENCY).alias("avg_latency_today"),
        F.max(AT).alias("last_violation_time"),
    )


def violation_type_distribution(fact: DataFrame, types: DataFrame) -> DataFrame:
    """Two pivoted counts; facts of unknown types do not appear."""
    per_type = fact.groupBy("violation_type_fk").agg(F.count("*").alias("n"))
    known = per_type.join(types, per_type.violation_type_fk == types.type_pk)

    def total(code):
        return F.coalesce(F.sum(F.when(F.col("type_code") == code, F.col("n"))), F.lit(0))

    return known.agg(
        total("no_helmet").alias("Tanpa Helm (Pengendara)"),
        total("no_helmet_passenger").alias("Tanpa Helm (Penumpang)"),
    )


def violation_type_detail(fact: DataFrame, types: DataFrame) -> DataFrame:
    """Every type, also without facts; the share is of all facts."""
    per_type = fact.groupBy("violation_type_fk").agg(*_sums())
    total = per_type.agg(F.nullif(F.sum("n"), F.lit(0))).scalar()
    n = F.coalesce("n", F.lit(0))
    return (
        types.join(per_type, types.type_pk == per_type.violation_type_fk, "left")
        .select(
            F.col("type_name").alias("Tipe Pelanggaran"),
            n.alias("Jumlah"),
            F.round(n * 100.0 / total, 1).alias("Persentase (%)"),
            choose(F.col("severity_level"), SEVERITY).alias("Severity"),
            F.round(_mean("conf"), 3).alias("Avg Confidence"),
            F.round(_mean("lat"), 1).alias("Avg Latency (ms)"),
        )
        .orderBy(F.desc("Jumlah"))
    )


def camera_geomap(fact: DataFrame, cameras: DataFrame) -> DataFrame:
    """Cameras with a position: totals, risk label, busiest hour and its period.

    The busiest hour comes from counts per (camera, hour): ties go to the earlier hour.
    """
    per_hour = fact.groupBy("camera_fk", "hour", "time_period").agg(*_sums())
    peak = F.max_by(F.struct("hour", "time_period"), F.struct("n", -F.col("hour"))).alias("peak")
    per_camera = per_hour.groupBy("camera_fk").agg(*_resum(), peak)
    placed = cameras.filter(F.col("gps_latitude").isNotNull() & F.col("gps_longitude").isNotNull())
    n = F.coalesce("n", F.lit(0))
    return placed.join(per_camera, placed.camera_pk == per_camera.camera_fk, "left").select(
        "camera_id",
        "camera_name",
        "location_description",
        F.col("gps_latitude").cast("double").alias("latitude"),
        F.col("gps_longitude").cast("double").alias("longitude"),
        n.alias("total_violations"),
        F.coalesce(F.round(_mean("conf"), 3), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.round(_mean("lat"), 1), F.lit(0.0)).alias("avg_latency_ms"),
        band(n, NO_RISK, RISK).alias("risk_level"),
        F.col("peak.hour").alias("peak_hour"),
        F.col("peak.time_period").alias("peak_period"),
        F.col("last_at").alias("last_violation"),
    )


def panel_hourly_bar(fact: DataFrame) -> DataFrame:
    return hourly_bar(fact).select("Jam", "Pelanggaran")


def panel_camera_risk(fact: DataFrame, cameras: DataFrame) -> DataFrame:
    return camera_geomap(fact, cameras).select(
        F.col("camera_name").alias("Kamera"),
        F.col("location_description").alias("Lokasi"),
        F.col("total_violations").alias("Total Pelanggaran"),
        F.col("risk_level").alias("Risk Level"),
        F.col("peak_hour").alias("Jam Puncak"),
        F.col("peak_period").alias("Periode Puncak"),
        F.col("avg_confidence").alias("Avg Confidence"),
        F.col("avg_latency_ms").alias("Avg Latency"),
        F.col("last_violation").alias("Pelanggaran Terakhir"),
    )


def panel_kpi_values(fact: DataFrame, as_of: str) -> DataFrame:
    """The four stat panels as ``(kpi, value)``."""
    names = ["violations_today", "avg_confidence", "avg_latency_ms", "total_violations_alltime"]
    kpis = kpi_summary(fact, as_of).select(*[F.col(c).cast("double").alias(c) for c in names])
    return kpis.unpivot([], names, "kpi", "value").filter(F.col("value").isNotNull())


def kpi_bands(fact: DataFrame, as_of: str) -> DataFrame:
    """Status colour of each banded KPI."""
    values = panel_kpi_values(fact, as_of).filter(F.col("kpi").isin(list(KPI_BANDS)))
    colour = None
    for kpi, (base, steps) in KPI_BANDS.items():
        hit = F.col("kpi") == kpi
        label = band(F.col("value"), base, steps)
        colour = F.when(hit, label) if colour is None else colour.when(hit, label)
    return values.withColumn("band", colour)


def heatmap_bands(fact: DataFrame) -> DataFrame:
    """Colour of every heat map cell and of every hourly bar, from one grouping."""
    days = [name for name, _ in WEEKDAYS]
    grid = heatmap_hour_day(fact).withColumn("all", sum((F.col(d) for d in days), F.lit(0)))
    cells = grid.unpivot(["Jam"], [*days, "all"], "series", "value")
    bar = F.col("series") == "all"
    return cells.withColumn(
        "band",
        F.when(bar, band(F.col("value"), HOURLY_BASE, HOURLY_BANDS)).otherwise(
            band(F.col("value"), HEATMAP_BASE, HEATMAP_BANDS)
        ),
    )
