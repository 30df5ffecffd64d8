"""Scripted micro-batches: deduplication, quarantine, replay, restart."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kerbline.operators.dedup import dedup_batch, late_events
from kerbline import session
from kerbline.plans import inputs
from kerbline.sources import event_json as ej
from kerbline.streaming import events as se

START = datetime(2024, 1, 15, 8, 30)


def message(event_id, track, second, camera="quay_01", **other):
    record = {
        "event_id": event_id, "track_id": track, "timestamp": (START + timedelta(seconds=second)).isoformat() + "+00:00",
        "camera_id": camera, "violation_type": "no_helmet", "confidence": 0.87, "bbox_x1": 1, "bbox_y1": 2,
        "bbox_x2": 3, "bbox_y2": 4, "frame_number": 5, "processing_latency_ms": 12.5,
    }
    record.update(other)
    return json.dumps(record)


def heartbeat(second):
    return json.dumps({"timestamp": (START + timedelta(seconds=second)).isoformat() + "+00:00"})


def drop_files(folder, batches):
    """One file per batch, with modification times in order."""
    os.makedirs(folder, exist_ok=True)
    for i, lines in enumerate(batches):
        path = os.path.join(folder, f"{i:03d}.txt")
        with open(path, "w") as f:
            f.write("\n".join(lines) + "\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


SCRIPT = [
    [message("k1@0", 1, 0)],
    [message("k1@45", 1, 45)],
    [message("k1@100", 1, 100), message("k2@100", 2, 100)],
    [message("k1@140", 1, 140), message("k9@20", 9, 20)],
    [message("k1@170", 1, 170)],
]


def test_star_job(spark, tmp_path):
    broken = ["no json", message("b1", "x", 200), message("b2", 3, 200, timestamp="not-a-time")]
    without_camera = json.loads(message("b3", 4, 200))
    del without_camera["camera_id"]
    drop_files(f"{tmp_path}/in", [*SCRIPT, [*broken, json.dumps(without_camera)], [heartbeat(400)]])
    tables = se.StarTables(f"{tmp_path}/star")
    settings = se.StreamSettings(available_now=True, shuffle_partitions=4)

    def run():
        messages = se.read_event_files(spark, f"{tmp_path}/in", max_files_per_trigger=1)
        queries = se.start_star_job(
            messages, inputs.dim_camera(spark), inputs.dim_violation_type(spark), tables, f"{tmp_path}/cp", settings
        )
        for q in queries:
            q.awaitTermination()
        fact = spark.read.option("basePath", tables.fact).parquet(tables.fact)
        return sorted(r.violation_pk for r in fact.collect())

    # k1@170 is 30 s after the last kept event of its key; lateness goes by the batch before.
    want = ["k1@0", "k1@100", "k1@140", "k1@45", "k2@100", "k9@20"]
    assert run() == want
    rejected = spark.read.parquet(tables.quarantine).collect()
    assert sorted(r.reject_reason for r in rejected) == [
        "missing camera_id",
        "missing event_id,missing track_id,missing event_timestamp,missing camera_id,missing violation_type,missing confidence",
        "missing event_timestamp",
        "missing track_id",
    ]
    assert "no json" in {r.raw_value for r in rejected}
    times = spark.read.option("basePath", tables.dim_time).parquet(tables.dim_time)
    assert times.count() == times.select("full_timestamp").distinct().count() == 5

    # Restart from the checkpoint: nothing new, then one more event.
    assert run() == want
    path = f"{tmp_path}/in/900.txt"
    with open(path, "w") as f:
        f.write(message("k5@500", 5, 500) + "\n" + heartbeat(900) + "\n")
    assert run() == sorted([*want, "k5@500"])


def test_replayed_batch_does_not_change_the_fact(spark, tmp_path, sf_dir):
    tables = se.StarTables(f"{tmp_path}/star")
    load = se.load_star(inputs.dim_camera(spark), inputs.dim_violation_type(spark), tables)
    rows = inputs.enriched_events(spark, sf_dir)
    load(rows, 0)
    load(rows.limit(0), 1)
    before = spark.read.parquet(tables.fact).count()
    load(rows, 0)
    assert spark.read.parquet(tables.fact).count() == before == rows.count()
    assert spark.read.parquet(tables.dim_time).count() == rows.select("event_timestamp").distinct().count()


def test_wire_round_trip(spark):
    value = message("e", 7, 1)
    parsed = ej.parse_events(spark.createDataFrame([(value,)], "value STRING"))
    again = ej.serialize_events(parsed).first()
    assert again.key == "7"
    want = json.loads(value)
    want["timestamp"] = "2024-01-15T08:30:01.000000+00:00"
    assert json.loads(again.value) == want


def greedy(times, horizon):
    kept, last = [], None
    for t in times:
        if last is None or t > last + horizon:
            kept.append(t)
            last = t
    return kept


@pytest.mark.parametrize("step", [1, 7, 30, 31])
def test_dedup_batch_on_a_long_chain(spark, step):
    """One key that is never quiet: the chain of kept events is as long as it gets."""
    seconds = sorted({i * step + (i * i) % 5 for i in range(400)})
    rows = [(f"e{i:04d}", 1, START + timedelta(seconds=s), "cam") for i, s in enumerate(seconds)]
    rows += [("zz", 1, START, "cam"), ("other", 2, START, "cam")]
    df = spark.createDataFrame(rows, "event_id STRING, track_id INT, event_timestamp TIMESTAMP, camera_id STRING")
    got = {r.event_id for r in dedup_batch(df, 30).select("event_id").collect()}
    at = {s: f"e{i:04d}" for i, s in enumerate(seconds)}
    assert got == {at[s] for s in greedy(seconds, 30)} | {"other"}


def test_dedup_batch_of_redeliveries_and_null_keys(spark):
    at = [START + timedelta(seconds=s) for s in range(100)]
    rows = [
        ("a", 1, at[0], "cam"), ("a", 1, at[0], "cam"), ("a", 1, at[5], "cam"), ("b", 1, at[31], "cam"),
        ("c", None, at[0], "cam"), ("d", None, at[10], "cam"), ("e", None, at[40], "cam"), ("f", 3, None, "cam"),
    ]
    df = spark.createDataFrame(rows, "event_id STRING, track_id INT, event_timestamp TIMESTAMP, camera_id STRING")
    assert sorted(r.event_id for r in dedup_batch(df, 30).collect()) == ["a", "b", "c", "e", "f"]


@pytest.mark.parametrize("per_batch", [2, 100])
def test_dedup_stream_does_not_depend_on_batches(spark, tmp_path, per_batch):
    """Repeats, null tracks and files in mixed order within the watermark, then a heartbeat."""
    lines, rows = [], []
    for i in range(120):
        second = 2 * i if i % 10 else 2 * i - 15
        track = None if i % 9 == 0 else i % 3
        rows.append((f"e{i:03d}", track, START + timedelta(seconds=second), "cam"))
        if i % 7 == 0:
            rows.append(rows[-1])
    schema = "event_id STRING, track_id INT, event_timestamp TIMESTAMP, camera_id STRING"
    for k in range(0, len(rows), 12):
        part = rows[k : k + 12]
        name = f"{tmp_path}/in/{k:03d}"
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(name)
        lines.append(name)
    spark.createDataFrame([(None, None, START + timedelta(days=1), None)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/999")
    for i, name in enumerate([*lines, f"{tmp_path}/in/999"]):
        for f in os.listdir(name):
            os.utime(f"{name}/{f}", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(f"{tmp_path}/in/*")
    query = (
        se.dedup_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(str, dedup_batch(spark.createDataFrame(rows, schema), 30).collect()))


def test_kafka_options():
    options = se.kafka_options(se.StreamSettings(8, topic="t", servers="broker:9092"))
    assert options["startingOffsets"] == "earliest" and "maxOffsetsPerTrigger" not in options
    assert options["failOnDataLoss"] == "true" and options["subscribe"] == "t"
    capped = se.StreamSettings(8, topic="t", max_offsets_per_trigger=7, starting_offsets="latest", fail_on_data_loss=False)
    options = se.kafka_options(capped)
    assert (options["maxOffsetsPerTrigger"], options["startingOffsets"], options["failOnDataLoss"]) == ("7", "latest", "false")
    assert se.kafka_sink_options(capped)["topic"] == "t"
    for call in (se.kafka_options, se.kafka_sink_options):
        with pytest.raises(ValueError, match="topic"):
            call(se.StreamSettings(8))


def test_shared_folder_is_required_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_nothing_is_left_in_the_shared_folder(spark, sf_dir):
    from kerbline.plans import catalog

    session.clear_scratch(spark)
    top = session.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(top))
    catalog.queries()["dedup_batch"](spark, sf_dir).count()
    assert set(os.listdir(top)) > before
    assert session.clear_scratch(spark) > 0
    assert set(os.listdir(top)) == before


def test_late_rows_counter(spark, tmp_path):
    drop_files(f"{tmp_path}/in", [[message("a", 1, 0)], [message("b", 2, 500)], [message("c", 3, 600)], [message("d", 4, 10)], [heartbeat(900)]])
    parsed = ej.parse_events(se.read_event_files(spark, f"{tmp_path}/in", 1), "kafka_timestamp")
    whole = ej.valid_events(parsed).unionByName(se.heartbeats(parsed))
    counter = se.LateRows()
    spark.streams.addListener(counter)
    try:
        query = (
            se.dedup_stream(whole).writeStream.format("parquet").option("path", f"{tmp_path}/out")
            .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(counter)
    assert counter.dropped[str(query.id)] == 1
    assert {r.event_id for r in spark.read.parquet(f"{tmp_path}/out").select(F.col("event_id")).collect()} == {"a", "b", "c"}


def rows_of(df):
    return sorted(str(r.asDict()) for r in df.select(sorted(df.columns)).collect())


def test_merged_dates_read_like_their_batches(spark, tmp_path, sf_dir):
    """Merging changes no row; repeated and late batches of a merged date do as before."""
    tables = se.StarTables(f"{tmp_path}/star")
    load = se.load_star(inputs.dim_camera(spark), inputs.dim_violation_type(spark), tables)
    events = inputs.enriched_events(spark, sf_dir)
    part = F.pmod(F.xxhash64("event_id"), F.lit(6))
    day = F.col("date") <= F.lit("2024-01-05").cast("date")
    events = events.filter(day).cache()
    for n in range(5):
        load(events.filter(part == n), n)
    days = sorted(r.date for r in events.select("date").distinct().collect())
    before = [rows_of(se.read_table(spark, p)) for p in (tables.fact, tables.dim_time)]
    for path in (tables.fact, tables.dim_time):
        se.merge_dates(spark, path, days[:-2])
        assert not os.path.exists(f"{path}/date={days[0]}") and len(os.listdir(f"{path}_merged")) > 2
    assert [rows_of(se.read_table(spark, p)) for p in (tables.fact, tables.dim_time)] == before
    load(events.filter(part == 3), 3)
    assert [rows_of(se.read_table(spark, p)) for p in (tables.fact, tables.dim_time)] == before
    load(events.filter(part == 5), 5)
    for again in (False, True):
        if again:
            se.merge_dates(spark, tables.fact, days)
            se.merge_dates(spark, tables.dim_time, days)
        fact = se.read_table(spark, tables.fact)
        assert fact.count() == fact.select("violation_pk").distinct().count() == events.count()
        times = se.read_table(spark, tables.dim_time)
        assert times.count() == events.select("event_timestamp").distinct().count()
    # Only the folders of the wanted dates are read.
    files = se.read_table(spark, tables.fact, days[:1]).inputFiles()
    assert files and all(f"date={days[0]}" in f for f in files)
    assert se.read_table(spark, f"{tmp_path}/nowhere") is None


def drain(stream, sink, checkpoint):
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def test_late_rows_come_out_as_rows(spark, tmp_path):
    seconds = [0, 40, 5, 90, 59, 61, 10, 300, 0, 269, 271]
    rows = [(f"e{i}", i, START + timedelta(seconds=s)) for i, s in enumerate(seconds)]
    schema = "event_id STRING, arrival BIGINT, event_timestamp TIMESTAMP"
    for i, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}")
        for f in os.listdir(f"{tmp_path}/in/{i:03d}"):
            os.utime(f"{tmp_path}/in/{i:03d}/{f}", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    sink = se.late_rows_sink(f"{tmp_path}/late")
    drain(stream, sink, f"{tmp_path}/cp")
    batch = late_events(spark.createDataFrame(rows, schema), "arrival")
    want = sorted((r.event_id, r.late_by_us) for r in batch.collect())

    def got():
        return sorted((r.event_id, r.late_by_us) for r in spark.read.parquet(f"{tmp_path}/late").collect())

    assert want and got() == want
    last = len(rows) - 1
    sink(spark.createDataFrame(rows[last:], schema), last)  # the last batch again
    assert got() == want and len(os.listdir(f"{tmp_path}/late_marks")) <= 3


def test_missing_events_on_a_stream(spark, tmp_path):
    """After a later row on both sides the rows of the batch query."""
    at = lambda s: START + timedelta(seconds=s)
    sent = [(f"e{i}", at(10 * i)) for i in range(12)]
    landed = [(f"e{i}", at(10 * i + (5 if i != 7 else 500))) for i in range(12) if i % 4 != 1]
    later = [("beat", at(3600))]
    for name, rows, column in (("sent", sent, "sent_at"), ("landed", landed, "landed_at")):
        schema = f"event_id STRING, {column} TIMESTAMP"
        for i, part in enumerate((rows[:6], rows[6:], later)):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/{i}")
    sides = [
        spark.readStream.schema(f"event_id STRING, {n}_at TIMESTAMP").parquet(f"{tmp_path}/{n}/*") for n in ("sent", "landed")
    ]
    query = (
        se.missing_events_stream(*sides).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"e1", "e5", "e9", "e7"}  # the seventh landed too late


def test_text_is_parsed_once(spark):
    """Conditions on parsed fields do not parse the text again."""
    lines = [message("a", 1, 0), "no json", None, message("b", "x", 1), message("c", 2, 2, timestamp="not-a-time")]
    parsed = ej.parse_events(spark.createDataFrame([(v,) for v in lines], "value STRING"))
    for kept in (ej.quarantine_events(parsed), ej.valid_events(parsed)):
        assert kept._jdf.queryExecution().executedPlan().toString().count("from_json(") == 1
    assert [r.event_id for r in ej.valid_events(parsed).collect()] == ["a"]
    found = sorted((str(r.event_id), r.track_id, r.reject_reason.count("missing")) for r in ej.quarantine_events(parsed).collect())
    assert found == [("None", None, 6), ("None", None, 6), ("b", None, 1), ("c", 2, 1)]
