"""What larger tables showed: many small files, frames in which nobody moves."""

import os

import numpy as np
import pytest

from courtline.operators import colours, frames, identity, teams
from courtline.plans import files as plans
from courtline.sources import files


def test_packed_files_equal_folders(spark, tmp_path):
    head = ",".join(files.CLIP_SCHEMA.names)
    row = lambda t, label: ",".join([str(t), *["1.5"] * 14, label])
    texts = {"A__videoplayback (1)_clip_1.csv": [head, row(1, "A"), "", row(2, "later")], "B__videoplayback_clip_2.csv": [head, row(1, "B")], "narrow": ["frame_id,ball_x", "1,2", "2,3"]}
    lines = spark.createDataFrame([(c, k, v) for c, t in texts.items() for k, v in enumerate(t)], "clip_id string, place int, value string")
    files.write_text_files(lines, f"{tmp_path}/folders", ["clip_id"], ["place"])
    files.pack_text_files(lines, f"{tmp_path}/packed", ["clip_id"], ["place"])
    both = f"{tmp_path}/folders", files.packed_lines(spark, f"{tmp_path}/packed")
    for read in (lambda p: files.scan_clips(spark, p)[0].select("clip_id", "frame_id", "label"), lambda p: files.scan_clips(spark, p)[1], lambda p: files.missing_columns(spark, p)):
        one, other = (sorted(map(tuple, read(p).collect())) for p in both)
        assert one == other and one
    names = spark.createDataFrame([(c,) for c in (*texts, "gone")], "name string")
    one, other = (sorted(map(str, files.file_manifest(spark, p, names, "clip_id").collect())) for p in (both[0], spark.read.parquet(f"{tmp_path}/packed")))
    assert one == other and len(one) == 4


def test_queries_pack_their_files(spark, sf_dir):
    top = spark.conf.get("spark.checkpoint.dir")
    for name in ("src1_clip_csv_scan", "src1_skipped_clips", "set4_missing_columns", "src4_label_file_scan", "src6_file_manifest"):
        before = set(os.listdir(top))
        plans.QUERIES[name](spark, sf_dir)
        (new,) = (x for x in set(os.listdir(top)) - before)
        assert not [x for x in os.listdir(f"{top}/{new}") if "=" in x], name


def test_nobody_moves(spark):
    rows = [(1, 0, t, k, 300.0 * k, 500.0, 900.0, 300.0) for t in (1, 2, 3) for k in range(1, 4)] + [(1, 1, 30, k, None, None, None, None) for k in range(1, 7)]
    p = spark.createDataFrame(rows, "match_id long, sequence long, frame_id long, slot int, x double, y double, ball_x double, ball_y double")
    assert [r.sync_score for r in frames.sync_score(frames.kinematics(frames.slot_velocity(p))).collect()] == [0.0, 0.0]
    got = {r.sequence: (r.n_frames, r.sync_score, r.mean_spacing_cm) for r in frames.window_metrics(frames.frame_channels(p)).collect()}
    assert got == {0: (3, 0.0, 300.0), 1: (1, 0.0, 0.0)}


@pytest.mark.parametrize("k", [1, 2, 4])
def test_clusters_of_many_groups(k):
    rng = np.random.default_rng(k)
    sizes = [1, 2, 3, 170, 5, 1, 60, 12, 90]
    parts = [rng.integers(0, 4, (n, 3)) / 7 if m % 2 else rng.random((n, 3)) for m, n in enumerate(sizes)] + [np.full((9, 3), 0.1), np.array([[np.nan, 1, 1], [0, 1, 1.0]])]
    group = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    centres, labels = colours.clusters_of(group, np.concatenate(parts), k)
    for g, p in enumerate(parts):
        want, own = colours.cluster(p, k)
        assert (labels[group == g] == own).all()
        assert np.array_equal(centres[g, : len(want)], want, equal_nan=True) and np.isinf(centres[g, len(want) :]).all()


def test_teams_of_many_clips(spark):
    rng = np.random.default_rng(3)
    rows = [(v, c, f, d, float(rng.integers(0, 900)) if rng.random() < 0.95 else None, *(float(x) for x in rng.random(3).round(2))) for v in (1, 2) for c in range(40) for f in range(1 + c % 7) for d in range(4)]
    df = spark.createDataFrame(rows, "video_id long, clip long, frame long, det_id int, y double, cx double, cy double, cv double").repartition(5)
    got = {(r.video_id, r.clip, r.cluster): (r.cx, r.cy, r.cv, r.n, r.median_y) for r in colours.fit_teams(df, ("video_id", "clip"), 12).collect()}
    want = {}
    for key in {r[:2] for r in rows}:
        own = sorted(r for r in rows if r[:2] == key and r[4] is not None)
        if len(own) >= 12:
            centres, labels = colours.cluster(np.array([r[5:] for r in own]), 4)
            y = np.array([r[4] for r in own])
            want |= {(*key, int(j)): (*centres[j].tolist(), int((labels == j).sum()), float(np.median(y[labels == j]))) for j in np.unique(labels)}
    assert got == want and len(got) > 100


@pytest.mark.parametrize(("chunk", "forget"), [(5, True), (64, True), (7, False)])
def test_votes_in_chunks(spark, chunk, forget):
    rng = np.random.default_rng(chunk)
    rows = [(v, f, f"t{k}" if k else None, d, str(rng.choice(["NEAR", "FAR", "UNKNOWN"]))) for v in (1, 2) for k in range(3) for f in range(90) for d in range(1) if rng.random() < (0.9, 0.97, 0.5)[k]]
    df = spark.createDataFrame(rows, "video_id long, frame long, track_id string, det_id int, team string").repartition(3)
    want, last = {}, {}
    for v, f, t, _, team in sorted(rows, key=lambda r: (r[0], str(r[2]), r[1])):
        near, far, at = last.get((v, t), (0.0, 0.0, f))
        fade = 0.0 if forget and f - at > 1 else 0.3 ** (f - at)
        last[v, t] = near, far, at = near * fade + (team == "NEAR"), far * fade + (team == "FAR"), f
        want[v, t, f] = near, far
    got = {(r.video_id, r.track_id, r.frame): (r.near, r.far) for r in teams.team_votes(df, 0.3, forget=forget, chunk=chunk).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-6) for k in want)


@pytest.mark.parametrize("seed", range(6))
def test_slots_frame_by_frame_of_pieces(seed):
    rng = np.random.default_rng(seed)
    rows = sorted((f, k, float(rng.integers(0, 500)), float(rng.integers(0, 200)) if rng.random() < 0.95 else np.nan) for k in range(9) for f in range(300) if (f // (7 + k)) % 3 != k % 2)
    frame, track, x, y = (np.array(c) for c in zip(*rows, strict=True))
    whole, held, parts = identity.stretch_slots(frame, track, x, y), [], []
    for lo, hi in zip([0, 3, 4, 60, 61, 200], [3, 4, 60, 61, 200, 300], strict=True):
        at = (frame >= lo) & (frame < hi)
        parts.append(identity.stretch_slots(frame[at], track[at], x[at], y[at], held=held))
    assert (np.concatenate(parts) == whole).all() and set(whole.tolist()) == set(range(7))
