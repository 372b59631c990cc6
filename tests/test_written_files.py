"""Files written and read back, and sinks that a repeated batch doesn't change."""

import json

from pyspark.sql import functions as F

from courtline.sources import files
from courtline.streaming import replay, sinks


def _clip(spark, name, label, n, columns):
    rows = spark.range(1, n + 1).select(F.lit(name).alias("clip_id"), F.col("id").alias("frame_id"), *(F.when((F.col("id") != 2) | (F.lit(c) != "p3_x"), F.col("id") + k / 4).alias(c) for k, c in enumerate(files.COORDINATES)), F.when(F.col("id") == 1, label).otherwise("later").alias("target_label"))
    return files.csv_lines(rows, columns)


def test_clips_in_folders(spark, tmp_path):
    names, path = files.CLIP_SCHEMA.names, str(tmp_path / "clips")
    lines = _clip(spark, "A_b__videoplayback (7)_clip_1.csv", "A b", 12, names).unionByName(_clip(spark, "C__videoplayback_clip_2.csv", "C", 3, names[::-1]))
    lines = lines.unionByName(_clip(spark, "short", "C", 1, names)).unionByName(_clip(spark, "narrow", "C", 4, names[:-2]))
    files.write_text_files(lines, path, ["clip_id"], ["place"])
    frames, skipped = files.scan_clips(spark, path)
    got = sorted((r.clip_id, r.video_key, r.folder, r.label, r.frame_id, r.ball_x, r.p3_x) for r in frames.collect())
    p3 = files.COORDINATES.index("p3_x") / 4
    want = [(name, key, folder, label, t, float(t), None if t == 2 else t + p3) for name, key, folder, label, n in (("A_b__videoplayback (7)_clip_1.csv", "(7)", "A_b", "A b", 12), ("C__videoplayback_clip_2.csv", "(plain)", "C", "C", 3)) for t in range(1, n + 1)]
    assert got == sorted(want)
    assert {r.clip_id: r.reason for r in skipped.collect()} == {"short": "under two rows", "narrow": "missing: p6_y,target_label"}
    assert {r.clip_id: r.missing for r in files.missing_columns(spark, path).collect()}["narrow"] == ["p6_y", "target_label"]
    first = next((tmp_path / "clips" / "clip_id=short").glob("*.txt")).read_text().splitlines()
    assert first[0] == ",".join(names) and len(first) == 2


def test_label_folders_and_manifest(spark, tmp_path):
    rows = [("train", "a", 2, "1.7 0 0 1 0 1 1"), ("train", "a", 1, "0.0 .5 .5 .1 .1"), ("val", "b", 1, "x .5 .5 .1 .1"), ("val", "b", 2, "nan .5 .5 .1 .1")]
    path = str(tmp_path / "labels")
    files.write_text_files(spark.createDataFrame(rows, "split string, stem string, k int, value string"), path, ["split", "stem"], ["k"])
    got = {(r.split, r.stem, r["class"], r.kind) for r in files.scan_label_files(spark, path).collect()}
    assert got == {("train", "a", 0, "box"), ("train", "a", 1, "polygon"), ("val", "b", None, "bad")}
    expected = spark.createDataFrame([("a",), ("gone",)], "name string")
    size = {r.name: r.size for r in files.file_manifest(spark, path, expected, "stem").collect()}
    assert size == {"a": len("0.0 .5 .5 .1 .1\n1.7 0 0 1 0 1 1\n"), "gone": None}


def test_summaries(spark):
    clips = spark.createDataFrame([(1, "B"), (1, "A"), (1, "AB"), (2, "C"), (2, "C"), (2, "A")], "video int, label string")
    got = {r["video"]: r for r in (json.loads(x.value) for x in files.clip_summaries(clips, "video", "label").collect())}
    assert got[1] == {"video": 1, "n_clips": 3, "class_counts": {"A": 1, "AB": 1, "B": 1}, "majority_baseline": {"label": "A", "accuracy": 0.3333}}
    assert got[2]["majority_baseline"] == {"label": "C", "accuracy": 0.6667}


def test_repeated_batch(spark, tmp_path):
    write, path = sinks.rows_once(str(tmp_path / "rows")), str(tmp_path / "rows")
    batches = [spark.range(0, 30, numPartitions=3), spark.range(30, 40, numPartitions=2)]
    for k in (0, 1, 1, 0):  # a batch is written again after the next one, too
        write(batches[k], k)
    assert sorted(r.id for r in sinks.written_rows(spark, path).collect()) == list(range(40))


def test_live_counts(spark, tmp_path):
    rows = spark.range(0, 200).select(F.concat(F.lit("l"), (F.col("id") % 3).cast("string")).alias("label"), (F.col("id") % 7 == 0).alias("is_anomaly")).repartition(10)
    path = str(tmp_path / "counts")
    replay.played(rows, sinks.live_label_counts, sinks.rows_once(path), "update", files=2)
    assert spark.read.parquet(path).select("batch_id").distinct().count() > 1
    got = {r.label: (r.n, r.n_anomalies) for r in sinks.newest_rows(spark, path, ["label"]).collect()}
    assert got == {f"l{k}": (sum(1 for i in range(200) if i % 3 == k), sum(1 for i in range(200) if i % 3 == k and i % 7 == 0)) for k in range(3)}
