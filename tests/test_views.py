"""Views on edge rows and on empty input."""

from datetime import datetime

import pytest

from kerbline.functions.labels import time_period, with_time_parts, with_time_period
from kerbline.plans import inputs, star, views

EVENT = (
    "event_id STRING, track_id INT, event_timestamp TIMESTAMP, camera_id STRING, violation_type STRING, "
    "confidence DOUBLE, bbox_x1 INT, bbox_y1 INT, bbox_x2 INT, bbox_y2 INT, frame_number INT, processing_latency_ms DOUBLE"
)


def fact(spark, rows):
    events = [(f"e{i}", i, datetime.fromisoformat(t), cam, kind, conf, 0, 0, 1, 1, i, lat) for i, (t, cam, kind, conf, lat) in enumerate(rows)]
    df = with_time_period(with_time_parts(spark.createDataFrame(events, EVENT)))
    return star.fact_rows(df, inputs.dim_camera(spark), inputs.dim_violation_type(spark))


@pytest.fixture(scope="module")
def empty(spark):
    return fact(spark, [])


def test_empty_fact(spark, empty):
    cameras, types = inputs.dim_camera(spark), inputs.dim_violation_type(spark)
    kpi = views.kpi_summary(empty, "2024-01-15").collect()
    assert len(kpi) == 1 and kpi[0].violations_today == 0 and kpi[0].avg_confidence is None
    for view in (views.heatmap_hour_day, views.hourly_bar):
        rows = view(empty).collect()
        assert len(rows) == 24 and all(v in (0, 0.0) for r in rows for v in r[1:])
    assert [r["Jumlah"] for r in views.confidence_distribution(empty).collect()] == [0] * 5
    assert tuple(views.time_period_distribution(empty).first()) == (0, 0, 0, 0)
    assert tuple(views.violation_type_distribution(empty, types).first()) == (0, 0)
    detail = views.violation_type_detail(empty, types).collect()
    assert len(detail) == 3 and all(r["Persentase (%)"] is None and r["Jumlah"] == 0 for r in detail)
    assert {r.risk_level for r in views.camera_geomap(empty, cameras).collect()} == {"Aman"}
    for view in (views.daily_trend, views.peak_hours):
        assert view(empty).count() == 0
    assert views.camera_stats(empty, cameras).count() == 0
    assert views.recent_violations(empty, cameras, types).count() == 0


def test_bucket_edges(spark):
    at = "2024-01-15 08:00:00"
    values = [0.45, 0.5, 0.6, 0.7, 0.8, 0.9]
    f = fact(spark, [(at, "quay_01", "no_helmet", v, 1.0) for v in values])
    got = {r["Range Confidence"]: r["Jumlah"] for r in views.confidence_distribution(f).collect()}
    assert got == {"0.5-0.6": 2, "0.6-0.7": 1, "0.7-0.8": 1, "0.8-0.9": 1, "0.9-1.0": 1}


def test_period_edges(spark):
    df = spark.createDataFrame([(h,) for h in (4, 5, 10, 11, 14, 15, 17, 18, None)], "hour INT")
    got = [r[0] for r in df.select(time_period(df.hour)).collect()]
    assert got == ["malam", "pagi", "pagi", "siang", "siang", "sore", "sore", "malam", "malam"]


def test_calendar_parts(spark):
    rows = [("2024-12-30 00:00:00", "x", "x", 0.5, 1.0), ("2024-01-06 23:59:59", "x", "x", 0.5, 1.0), ("2024-01-07 00:00:00", "x", "x", 0.5, 1.0)]
    parts = {(r.week_of_year, r.day_of_week) for r in fact(spark, rows).collect()}
    assert parts == {(1, 2), (1, 7), (1, 1)}


def test_unknown_keys_and_ties(spark):
    rows = [
        ("2024-01-15 09:00:00", "nowhere", "strange", 0.7, 10.0),
        ("2024-01-15 07:10:00", "quay_01", "no_helmet", 0.9, 20.0),
        ("2024-01-15 16:10:00", "quay_01", "no_helmet", 0.8, 30.0),
        ("2024-01-14 16:10:00", "dark_01", "no_helmet", 0.8, None),
    ]
    f = fact(spark, rows).cache()
    cameras, types = inputs.dim_camera(spark), inputs.dim_violation_type(spark)
    stats = {r.camera_id: r for r in views.camera_stats(f, cameras).collect()}
    assert stats[None].total_violations == 1 and stats[None].camera_name is None and stats[None].location == "-"
    geo = {r.camera_id: r for r in views.camera_geomap(f, cameras).collect()}
    assert "dark_01" not in geo
    assert (geo["quay_01"].peak_hour, geo["quay_01"].peak_period) == (7, "pagi")
    kpi = views.kpi_summary(f, "2024-01-20").first()
    assert kpi.violations_today == 0 and kpi.avg_latency_ms == 20.0 and kpi.last_violation_time is None
    assert [r["Tipe"] for r in views.recent_violations(f, cameras, types, 2).collect()] == ["Rider without helmet", "-"]
    share = {r["Tipe Pelanggaran"]: r["Persentase (%)"] for r in views.violation_type_detail(f, types).collect()}
    assert float(share["Rider without helmet"]) == 75.0 and float(share["No facts for this type"]) == 0.0


def test_facts_on_a_zone(spark):
    events = spark.createDataFrame([(datetime(2024, 1, 15, 20, 0),)], "event_timestamp TIMESTAMP")
    row = with_time_parts(events, tz="Asia/Jakarta").first()
    assert (row.hour, row.date.day) == (3, 16)


def test_seed_keeps_the_first_of_equal_keys(spark):
    seed = spark.createDataFrame([("a", "first", 1), ("a", "second", 2), ("b", "known", 3)], "id STRING, name STRING, n INT")
    old = spark.createDataFrame([("b", "old", 0)], "id STRING, name STRING, n INT")
    assert [(r.id, r.name) for r in star.seed_dimension(seed, old, "id", "n").collect()] == [("a", "first")]
