"""File sources, sinks and streams."""

import hashlib

import pytest
from pyspark.sql import functions as F

from courtline.operators import identity
from courtline.sources import files
from courtline.streaming import live


def test_clip_scan(spark, tmp_path):
    head = ",".join(files.CLIP_SCHEMA.names)
    row = lambda t, label: ",".join([str(t), *["1.5"] * 14, label])
    (tmp_path / "Delayed_Support__videoplayback (1)_clip_001.csv").write_text("\n".join([head, row(1, "Delayed Support"), row(2, "Delayed Support")]))
    (tmp_path / "A__videoplayback_clip_002.csv").write_text("\n".join([head, row(1, "x")]))
    (tmp_path / "B__bad_clip.csv").write_text("frame_id,ball_x\n1,2\n2,3")
    frames, skipped = files.scan_clips(spark, str(tmp_path))
    got = frames.collect()
    assert {(r.clip_id, r.video_key, r.folder, r.label, r.frame_id) for r in got} == {("Delayed_Support__videoplayback%20(1)_clip_001.csv" if "%20" in got[0].clip_id else "Delayed_Support__videoplayback (1)_clip_001.csv", got[0].video_key, "Delayed_Support", "Delayed Support", t) for t in (1, 2)}
    assert {r.reason.split(":")[0] for r in skipped.collect()} == {"under two rows", "missing"}


def test_label_lines(spark):
    lines = spark.createDataFrame([("0 .5 .5 .1 .1", "a"), ("1 0 0 1 0 1 1", "a"), ("0 .1 .2 .3", "b"), ("0 .5 .5 .1 7", "b")], "value string, stem string").withColumn("split", F.lit("train"))
    got = files.label_file_audit(files.parse_label_lines(lines)).first()
    assert (got.n_box, got.n_polygon, got.n_bad, got.n_files) == (1, 1, 2, 2)


def test_manifest_and_sinks(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    got = {r.name: (r.sha, r.size) for r in files.file_manifest(spark, str(tmp_path), ["a.bin", "b.bin"]).collect()}
    assert got == {"a.bin": (hashlib.sha256(b"abc").hexdigest()[:12], 3), "b.bin": (None, None)}
    rows = spark.createDataFrame([(1, {"A b": 0.25})], "sequence long, probs map<string, double>")
    wide = files.probability_columns(rows, ["A b"])
    assert wide.first().p_a_b == 0.25
    files.write_table(wide, str(tmp_path / "out"))
    with pytest.raises(Exception, match="exist"):
        files.write_table(wide, str(tmp_path / "out"))
    assert files.summary_json(wide).first().value == '{"sequence":1,"p_a_b":0.25}'


def _stream(spark, tmp_path, rows, schema):
    source = tmp_path / "in"
    for k in range(0, len(rows), 20):
        spark.createDataFrame(rows[k : k + 20], schema).coalesce(1).write.mode("append").parquet(str(source))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))


def test_live_ball_equals_batch(spark, tmp_path):
    schema = "video_id long, frame long, ball_x double, ball_y double"
    rows = [(v, t, None if t % 7 > 4 or t > 44 else 10.0 * t, None if t % 7 > 4 or t > 44 else 3.0) for t in range(60) for v in (1, 2)]
    q = live.live_ball(_stream(spark, tmp_path, rows, schema)).writeStream.format("memory").queryName("ball").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("ball")
    batch = identity.track_ball(spark.createDataFrame(rows, schema))
    key = lambda r: (r.video_id, r.frame, None if r.ball_x is None else round(r.ball_x, 9), r.predicted)
    assert got.where("late").isEmpty() and got.where("predicted").count() > 10
    assert sorted(map(str, map(key, got.collect()))) == sorted(map(str, map(key, batch.collect())))


def test_live_windows(spark, tmp_path):
    rows = [(1, t) for t in range(1, 200) if t != 40]
    q = live.count_windows(_stream(spark, tmp_path, rows, "video_id long, frame long")).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.sequence: (r.n_frames, r.whole) for r in spark.table("windows").collect()}
    assert got[0] == (29, True) and got[1] == (28, False)
