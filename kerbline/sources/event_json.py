"""Event wire format: JSON text keyed by the track id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.schemas import REQUIRED_EVENT_FIELDS, WIRE_EVENT


def serialize_events(events: DataFrame) -> DataFrame:
    """Event rows to ``(key, value)``. Box corners are truncated to int, time is ISO-8601."""
    iso = F.date_format("event_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    fields = {
        "timestamp": iso,
        **{c: F.col(c).cast("int") for c in ("bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")},
    }
    record = F.struct(*[fields.get(f, F.col(f)).alias(f) for f in WIRE_EVENT.fieldNames()])
    return events.select(
        F.col("track_id").cast("string").alias("key"),
        F.to_json(record, {"ignoreNullFields": "false"}).alias("value"),
    )


def parse_events(messages: DataFrame, arrival: str | None = None) -> DataFrame:
    """JSON text in ``value`` to typed columns and ``event_timestamp``.

    Text that is no JSON gives a row of NULLs, a field of the wrong type gives NULL in that
    field, and a time that does not parse gives a NULL ``event_timestamp``. The text is parsed once: as the
    output of an ``explode`` of one element it is not copied into the conditions of later filters.
    """
    parsed = messages.select(
        F.explode(F.array(F.from_json(F.col("value").cast("string"), WIRE_EVENT))).alias("e"),
        *([F.col(arrival).alias("kafka_timestamp")] if arrival else []),
        F.col("value").cast("string").alias("raw_value"),
    )
    kept = ["e.*"] + (["kafka_timestamp"] if arrival else []) + ["raw_value"]
    return parsed.select(*kept).withColumn("event_timestamp", F.try_to_timestamp("timestamp"))


def _reasons():
    return F.concat_ws(
        ",", *[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in REQUIRED_EVENT_FIELDS]
    )


def valid_events(parsed: DataFrame) -> DataFrame:
    """Rows that have every required field."""
    return parsed.filter(" AND ".join(f"{c} IS NOT NULL" for c in REQUIRED_EVENT_FIELDS)).drop("raw_value")


def quarantine_events(parsed: DataFrame) -> DataFrame:
    """Rows that lack a required field, with the reason and the text as received."""
    broken = parsed.filter(" OR ".join(f"{c} IS NULL" for c in REQUIRED_EVENT_FIELDS))
    return broken.withColumn("reject_reason", _reasons())


def publish_reconciliation(sent: DataFrame, landed: DataFrame) -> DataFrame:
    """Events sent against events landed, per run.

    ``sent(run_id, event_id, sent_at)``, ``landed(event_id, landed_at)``.
    """
    first = landed.groupBy("event_id").agg(F.min("landed_at").alias("landed_at"))
    pairs = sent.join(first, "event_id", "left")
    arrived = F.count("landed_at")
    seconds = (F.unix_micros(F.max("landed_at")) - F.unix_micros(F.min("sent_at"))) / 1e6
    return pairs.groupBy("run_id").agg(
        F.count("*").alias("messages_sent"),
        arrived.alias("messages_processed"),
        (F.count("*") - arrived).alias("messages_missing"),
        F.round(100.0 * arrived / F.count("*"), 1).alias("success_rate"),
        F.round(seconds, 2).alias("end_to_end_seconds"),
    )


def missing_events(sent: DataFrame, landed: DataFrame) -> DataFrame:
    """Events that were sent and never landed."""
    return sent.join(landed.select("event_id"), "event_id", "left_anti")
