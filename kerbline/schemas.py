"""Declared schemas of the relations and of the wire record."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names and order of the JSON record. Confidence and latency are DOUBLE: a 32-bit
# float would turn 0.87 into 0.8700000047683716.
WIRE_EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("track_id", T.IntegerType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("camera_id", T.StringType()),
        T.StructField("violation_type", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("bbox_x1", T.IntegerType()),
        T.StructField("bbox_y1", T.IntegerType()),
        T.StructField("bbox_x2", T.IntegerType()),
        T.StructField("bbox_y2", T.IntegerType()),
        T.StructField("frame_number", T.IntegerType()),
        T.StructField("processing_latency_ms", T.DoubleType()),
    ]
)

REQUIRED_EVENT_FIELDS = (
    "event_id",
    "track_id",
    "event_timestamp",
    "camera_id",
    "violation_type",
    "confidence",
)

DIM_CAMERA = (
    "camera_pk BIGINT, camera_id STRING, camera_name STRING, location_description STRING, "
    "gps_latitude DECIMAL(10,8), gps_longitude DECIMAL(11,8)"
)
DIM_VIOLATION_TYPE = "type_pk BIGINT, type_code STRING, type_name STRING, severity_level INT"
DETECTION = (
    "camera_id BIGINT, session_id STRING, frame_number BIGINT, det_idx INT, track_id BIGINT, "
    "class_id INT, confidence DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"
)
