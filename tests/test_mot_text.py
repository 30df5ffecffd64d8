"""MOT text files: write, read, odd lines."""

from pyspark.sql import functions as F

from kerbline.plans import inputs
from kerbline.sources import mot_text as mt


def test_write_and_read_back(spark, tmp_path, sf_dir):
    rows = mt.mot_pred_rows(inputs.detections(spark, sf_dir))
    mt.write_mot(rows, f"{tmp_path}/pred")
    back = mt.read_mot(spark, f"{tmp_path}/pred")
    want = rows.select("sequence_id", *mt.MOT_FIELDS)
    assert back.exceptAll(want).isEmpty() and want.exceptAll(back).isEmpty()


def test_odd_lines(spark):
    lines = [("s", "1,2,3,4,5,6"), ("s", "1,2,3,4,5,6,0.5"), ("s", "2,3,1.5,2,3,4,0.25,2,-1,-1"), ("s", "")]
    df = spark.createDataFrame(lines, "sequence_id STRING, value STRING")
    got = sorted(tuple(r) for r in mt.parse_mot_lines(df).collect())
    assert got == [("s", 1, 2, 3.0, 4.0, 5.0, 6.0, 0.5, -1), ("s", 2, 3, 1.5, 2.0, 3.0, 4.0, 0.25, 2)]
    assert mt.parse_mot_lines(df, [2]).count() == 1
    assert mt.parse_mot_lines(df, []).count() == 2


def test_propagate_stops_at_the_last_frame(spark):
    schema = "sequence_id STRING, frame BIGINT, id BIGINT, bb_left DOUBLE, bb_top DOUBLE, bb_w DOUBLE, bb_h DOUBLE, conf DOUBLE, class_id INT"
    boxes = spark.createDataFrame([("s", 1, 1, 0.0, 0.0, 5.0, 5.0, 1.0, 1), ("s", 3, 1, 9.0, 0.0, 5.0, 5.0, 1.0, 1), ("s", 4, 2, 0.0, 0.0, 5.0, 5.0, 1.0, 1)], schema)
    last = spark.createDataFrame([("s", 4)], "sequence_id STRING, last_frame BIGINT")
    got = sorted((r.frame, r.id, r.bb_left) for r in mt.propagate_boxes(boxes, boxes.filter("id = 1"), 5, last).collect())
    assert got == [(1, 1, 0.0), (2, 1, 0.0), (3, 1, 9.0), (4, 1, 0.0), (4, 2, 0.0)]


def test_sequence_descriptions(spark, tmp_path):
    schema = "sequence_id STRING, frame_rate INT, seq_length BIGINT, im_width INT, im_height INT"
    rows = [("0_s0", 25, 3000, 1280, 720), ("1_s0", 30, 12, 640, 480)]
    mt.write_sequence_info(spark.createDataFrame(rows, schema), f"{tmp_path}/info")
    text = next((tmp_path / "info" / "sequence_id=0_s0").glob("part-*")).read_text()
    assert text.splitlines() == [
        "[Sequence]", "name=0_s0", "imDir=img1", "frameRate=25", "seqLength=3000", "imWidth=1280", "imHeight=720", "imExt=.jpg",
    ]
    odd = tmp_path / "info" / "sequence_id=odd"
    odd.mkdir()
    (odd / "a.txt").write_text("[Other]\nname=no\n[Sequence]\r\nNAME = x = y\nframeRate=fast\nnothing\nseqLength= 7 \n[End]\nimWidth=1\n")
    got = sorted(tuple(r) for r in mt.read_sequence_info(spark, f"{tmp_path}/info").collect())
    assert got == [(*[s, s], "img1", *rest, ".jpg") for s, *rest in rows] + [("odd", "x = y", None, None, 7, None, None, None)]


def test_boxes_of_a_sequence_are_dealt_out(spark):
    """One long sequence does not meet in one task; sequences without truth and without a name keep their predictions."""
    box = [F.lit(1.0).alias(c) for c in mt.MOT_FIELDS[2:7]]
    rows = spark.range(4000).select(F.element_at(F.array(*map(F.lit, ["long", "other", None])), (F.col("id") % 3 + 1).cast("int")).alias("sequence_id"), F.col("id").alias("frame"), "id", *box, F.lit(1).alias("class_id"))
    truth = rows.filter("sequence_id = 'long' and id < 30")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        kept = mt.annotation_source(truth, rows.filter("sequence_id = 'other' or sequence_id is null"))
        largest = kept.filter("sequence_id = 'other'").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        whole = mt.annotation_source(truth, rows)
        assert whole.filter("sequence_id = 'long'").count() == truth.count() == 10
        assert whole.filter("sequence_id is null or sequence_id = 'other'").count() == rows.filter("sequence_id is null or sequence_id = 'other'").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert largest < 700
