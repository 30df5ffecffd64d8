"""Event stream to star schema: source, deduplication, idempotent load."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import date

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from kerbline.functions.labels import with_time_parts, with_time_period
from kerbline.plans.star import dim_time_rows, fact_rows
from kerbline.session import cut_lineage
from kerbline.sources.event_json import parse_events, quarantine_events, valid_events
from kerbline.streaming.ordered_state import ROCKSDB, STATE_STORE, InTimeOrder, in_time_order, micros


@dataclass(frozen=True)
class StreamSettings:
    """Job settings. ``available_now`` drains what is there and stops, for tests and backfills."""

    # Frozen in the checkpoint at the first start: choose for the expected state size.
    shuffle_partitions: int
    topic: str | None = None
    trigger: str = "5 seconds"
    available_now: bool = False
    # Unset: a trigger reads all there is, so a backlog does not age out of the topic.
    max_offsets_per_trigger: int | None = None
    starting_offsets: str = "earliest"
    fail_on_data_loss: bool = True
    watermark: str = "30 seconds"
    horizon_seconds: int = 30
    servers: str = field(default_factory=lambda: os.environ.get("KAFKA_BOOTSTRAP_SERVERS", "localhost:9092"))

    def start(self, spark: SparkSession, writer) -> StreamingQuery:
        """Start with this job's partition count and state store; the session's own settings are put back."""
        how = {"availableNow": True} if self.available_now else {"processingTime": self.trigger}
        wanted = {"spark.sql.shuffle.partitions": str(self.shuffle_partitions), STATE_STORE: ROCKSDB}
        before = {name: spark.conf.get(name) for name in wanted}
        try:
            for name, value in wanted.items():
                spark.conf.set(name, value)
            return writer.trigger(**how).start()
        finally:
            for name, value in before.items():
                spark.conf.set(name, value)


def kafka_options(settings: StreamSettings) -> dict[str, str]:
    if not settings.topic:
        raise ValueError("the topic is a required setting")
    options = {
        "kafka.bootstrap.servers": settings.servers,
        "subscribe": settings.topic,
        "startingOffsets": settings.starting_offsets,
        "failOnDataLoss": str(settings.fail_on_data_loss).lower(),
    }
    if settings.max_offsets_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(settings.max_offsets_per_trigger)
    return options


def kafka_sink_options(settings: StreamSettings) -> dict[str, str]:
    """Options of a Kafka writer for ``(key, value)`` rows; batch and stream take the same."""
    if not settings.topic:
        raise ValueError("the topic is a required setting")
    return {"kafka.bootstrap.servers": settings.servers, "topic": settings.topic}


def write_events(rows: DataFrame, settings: StreamSettings, checkpoint: str | None = None):
    """A Kafka writer of serialized events: a stream writer where ``rows`` is a stream, else a batch
    writer, both to be started by the caller. Needs the Kafka connector jar."""
    narrow = rows.select("key", "value")
    options = kafka_sink_options(settings)
    if rows.isStreaming:
        return narrow.writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint)
    return narrow.write.format("kafka").options(**options)


def read_event_stream(spark: SparkSession, settings: StreamSettings) -> DataFrame:
    """Messages of the topic as ``(value, kafka_timestamp)``. Needs the Kafka connector jar."""
    source = spark.readStream.format("kafka").options(**kafka_options(settings)).load()
    return source.select(F.col("value").cast("string"), F.col("timestamp").alias("kafka_timestamp"))


def read_event_files(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same stream from a folder of text files, one message per line.

    The arrival time is the modification time of the file.
    """
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    source = reader.load(path)
    return source.select("value", F.col("_metadata.file_modification_time").alias("kafka_timestamp"))


class _FirstAfterHorizon(InTimeOrder):
    """Keeps a row that is later than the last kept one of its key by more than the horizon."""

    time, ties = "event_timestamp", ("event_id",)

    def __init__(self, horizon_us: int, columns: list[str]):
        self.horizon_us, self.columns = horizon_us, columns

    def wanted(self, carry, rows):
        # A row without an id only moves the watermark.
        return carry, rows.loc[rows["event_id"].notna(), self.columns]

    def expires(self, carry):
        # Beyond that no row can be within the horizon of the last kept one.
        return None if carry is None else (carry + self.horizon_us) // 1000 + 1

    def judge(self, carry, rows):
        at = micros(rows["event_timestamp"])
        after = np.searchsorted(at, at + self.horizon_us, "right").tolist()
        kept, i = [], 0 if carry is None else int(np.searchsorted(at, carry + self.horizon_us, "right"))
        while i < len(after):
            kept.append(i)
            i = after[i]
        return (int(at[kept[-1]]) if kept else carry), rows.iloc[kept]


def dedup_stream(events: DataFrame, watermark: str = "30 seconds", horizon_seconds: int = 30) -> DataFrame:
    """An event is kept if it is later than the last kept event of its (track, camera) by more than
    the horizon: the rule of :func:`kerbline.operators.dedup.dedup_batch`, whatever the batches.

    Rows wait in the state until the watermark has passed them, in buckets of bounded size
    (:mod:`kerbline.streaming.ordered_state`). Rows behind the watermark on arrival are dropped by Spark and counted
    (:class:`LateRows`). A row without an event id is a heartbeat: it moves the watermark and yields
    nothing, so after a drain one of them, later than all events, releases what waits. Null keys are a
    key like others.
    """
    rule = _FirstAfterHorizon(horizon_seconds * 1_000_000, events.columns)
    return in_time_order(events.withWatermark("event_timestamp", watermark), ["track_id", "camera_id"], rule, events.schema)


def is_heartbeat() -> Column:
    """A message of a time and nothing else."""
    return F.col("event_timestamp").isNotNull() & F.coalesce("event_id", F.col("track_id").cast("string"), "camera_id").isNull()


def heartbeats(parsed: DataFrame) -> DataFrame:
    return parsed.filter(is_heartbeat()).drop("raw_value")


def enrich(events: DataFrame) -> DataFrame:
    return with_time_period(with_time_parts(events))


@dataclass(frozen=True)
class StarTables:
    """Folder layout of the star schema."""

    root: str

    @property
    def fact(self) -> str:
        return f"{self.root}/fact_violations"

    @property
    def dim_time(self) -> str:
        return f"{self.root}/dim_time"

    @property
    def quarantine(self) -> str:
        return f"{self.root}/quarantine"


def _folder(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _exists(spark: SparkSession, path: str) -> bool:
    files, folder = _folder(spark, path)
    return files.exists(folder)


def _has_dates(spark: SparkSession, path: str) -> bool:
    files, folder = _folder(spark, path)
    return files.exists(folder) and any(f.getPath().getName().startswith("date=") for f in files.listStatus(folder))


def _append_once(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write a batch under its dates and its own number: a repeated batch replaces itself."""
    numbered = rows.withColumn("batch_id", F.lit(batch_id))
    writer = numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("date", "batch_id").parquet(path)


def _merged(path: str) -> str:
    """Where the merged dates of a table lie: one folder a date, the batch number is a column."""
    return f"{path}_merged"


def read_table(spark: SparkSession, path: str, dates: Sequence[date] | None = None) -> DataFrame | None:
    """A star table, or some of its dates; None where there is nothing.

    Only the folders of the wanted dates are listed. A batch that was merged is not read again from its own folder.
    """

    def part(root: str) -> DataFrame | None:
        if dates is None:
            paths = [root] if _has_dates(spark, root) else []
        else:
            paths = [p for p in (f"{root}/date={d}" for d in dates) if _exists(spark, p)]
        return spark.read.option("basePath", root).parquet(*paths) if paths else None

    own, merged = part(path), part(_merged(path))
    if merged is None:
        return own
    if own is None:
        return merged
    # A row per date and merged batch.
    known = part(f"{_merged(path)}_batches")
    return own.join(known, ["date", "batch_id"], "left_anti").unionByName(merged.select(own.columns))


def merge_dates(spark: SparkSession, path: str, dates: Sequence[date]) -> None:
    """Merge the batches of each date into one folder. Run it for dates that get few new events; late ones are added by their batch.

    A date is written whole before its batches are named as merged, and only then their folders go, so a
    job that ends in between leaves the table as it was or as it should be. A batch that comes again is the same rows and is not read.
    """
    for day in dates:
        rows = read_table(spark, path, [day])
        if rows is None or not _exists(spark, f"{path}/date={day}"):
            continue
        rows = cut_lineage(rows)
        index = cut_lineage(rows.select("date", "batch_id").distinct())
        for data, root in ((rows, _merged(path)), (index, f"{_merged(path)}_batches")):
            data.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(root)
        files, folder = _folder(spark, f"{path}/date={day}")
        files.delete(folder, True)


def load_star(cameras: DataFrame, types: DataFrame, tables: StarTables) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: new times first, then the facts. Empty batches are skipped."""

    def load(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            days = [r["date"] for r in batch.select("date").distinct().collect()]  # a row per day of the batch
            if not days:
                return
            times = dim_time_rows(batch)
            known = read_table(spark, tables.dim_time, days)
            if known is not None:
                known = known.filter(F.col("batch_id") != batch_id).select("full_timestamp")
                times = times.join(known, "full_timestamp", "left_anti")
            _append_once(times, tables.dim_time, batch_id)
            _append_once(fact_rows(batch, cameras, types), tables.fact, batch_id)
        finally:
            batch.unpersist()

    return load


def start_star_job(
    messages: DataFrame,
    cameras: DataFrame,
    types: DataFrame,
    tables: StarTables,
    checkpoint: str,
    settings: StreamSettings,
) -> list[StreamingQuery]:
    """Parse, quarantine, enrich, deduplicate and load. Returns the two running queries."""
    spark = messages.sparkSession
    parsed = parse_events(messages, arrival="kafka_timestamp")
    # A message with nothing but a time is a heartbeat: not an event, but it moves the watermark.
    whole = valid_events(parsed).unionByName(heartbeats(parsed))
    clean = dedup_stream(enrich(whole), settings.watermark, settings.horizon_seconds)
    facts = (
        clean.writeStream.outputMode("append")
        .option("checkpointLocation", f"{checkpoint}/facts")
        .foreachBatch(load_star(cameras, types, tables))
    )
    rejects = (
        quarantine_events(parsed.filter(~is_heartbeat()))
        .writeStream.outputMode("append")
        .option("checkpointLocation", f"{checkpoint}/quarantine")
        .format("parquet")
        .option("path", tables.quarantine)
    )
    return [settings.start(spark, facts), settings.start(spark, rejects)]


def late_rows_sink(path: str, delay_seconds: int = 30) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink that writes the rows which arrive behind the watermark, with their lateness, to ``path``.

    Spark drops such rows inside its operators; put this sink on the events before them. Rows of a batch arrive
    together, so they are held against the latest time of the batches before, like
    :func:`kerbline.operators.dedup.late_events`. That time is one row beside the late rows, kept for the last two batches:
    a repeated batch finds the one it was judged by and replaces its rows.
    """

    def marks(spark: SparkSession, batch_id: int) -> int | None:
        folder = f"{path}_marks/batch_id={batch_id}"
        return spark.read.parquet(folder).first()["latest"] if _exists(spark, folder) else None

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = marks(spark, batch_id - 1)
        at = F.unix_micros("event_timestamp")
        batch = batch.persist()
        try:
            if before is not None:
                behind = batch.withColumn("late_by_us", F.lit(before - delay_seconds * 1_000_000) - at).filter("late_by_us > 0")
                behind.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
            latest = batch.agg(F.greatest(F.max(at), F.lit(before).cast("bigint")).alias("latest"))
            latest.write.mode("overwrite").parquet(f"{path}_marks/batch_id={batch_id}")
        finally:
            batch.unpersist()
        files, folder = _folder(spark, f"{path}_marks/batch_id={batch_id - 2}")
        files.delete(folder, True)

    return sink


def missing_events_stream(sent: DataFrame, landed: DataFrame, within: str = "1 minute", delay: str = "30 seconds") -> DataFrame:
    """Sent events that have not landed ``within`` their time: ``(event_id, sent_at)``, as soon as that time is over.

    ``sent(event_id, sent_at)`` and ``landed(event_id, landed_at)`` are streams; the batch form is
    :func:`kerbline.sources.event_json.missing_events`. An event comes out when the watermarks of both sides have passed
    its time, so a later row on either side releases what waits.
    """
    left = sent.select(F.col("event_id").alias("sent_id"), "sent_at").withWatermark("sent_at", delay)
    right = landed.select("event_id", "landed_at").withWatermark("landed_at", delay)
    in_time = F.expr(f"landed_at >= sent_at and landed_at <= sent_at + interval {within}")
    both = left.join(right, (F.col("sent_id") == F.col("event_id")) & in_time, "left_outer")
    return both.filter("event_id is null").select(F.col("sent_id").alias("event_id"), "sent_at")


class LateRows(StreamingQueryListener):
    """Rows that stateful operators dropped as late, summed per query over its whole run.

    Register with ``spark.streams.addListener`` before the query starts.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        late = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        self.dropped[str(progress.id)] = self.dropped.get(str(progress.id), 0) + late

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
