"""Verdicts by gate, model and rules; training history against a plain loop; the table function of slots."""

import numpy as np
from pyspark.sql import functions as F

from courtline.operators import clean, court, descent, scores


def test_verdict_order(spark):
    def window(seq, step):
        return [(1, seq, seq * 29 + t + 1, k, 200.0 * k + step * t, 300.0 + 50 * (k % 3), 100.0, 200.0) for t in range(29) for k in range(1, 7)]

    raw = spark.createDataFrame(window(0, 0.0) + window(1, 9.0) + window(2, 9.0), "match_id long, sequence long, frame_id long, slot int, x double, y double, ball_x double, ball_y double")
    told = "match_id long, sequence long, label string, confidence double, entropy double, entropy_norm double, is_anomaly boolean, probs map<string, double>"
    scored = spark.createDataFrame([(1, s, "Delayed Support", 0.4, 1.5, 0.7, True, {"Delayed Support": 0.4}) for s in (0, 1)], told)
    rules = {r.sequence: r.label for r in court.window_verdicts(raw).collect()}
    got = {r.sequence: r for r in court.window_verdicts(raw, scored=scored).collect()}
    assert {k: (v.by, v.label) for k, v in got.items()} == {0: ("gate", "Unclassified"), 1: ("model", "Delayed Support"), 2: ("rules", rules[2])}
    assert [(got[k].confidence, got[k].is_anomaly, got[k].probs) for k in (0, 1, 2)] == [(1.0, False, None), (0.4, True, {"Delayed Support": 0.4}), (1.0, False, None)]


def _plain(y, val, x, epochs, rate):
    """Macro F1 and loss of the validation rows and weights for each epoch, row by row."""
    mean, dev = np.nanmean(x[~val], axis=0), np.nanstd(x[~val], axis=0)
    z = np.where(np.isnan(x), 0, (x - mean) / dev)
    k = y.max() + 1
    n = [int(((y == c) & ~val).sum()) for c in range(k)]
    w, out = np.zeros((k, x.shape[1] + 1)), []
    for _ in range(epochs):
        grad, pred, loss = np.zeros_like(w), [], 0.0
        for i in range(len(y)):
            row = np.append(z[i], 1.0)
            p = np.exp(w @ row)
            p /= p.sum()
            pred.append(int(p.argmax()))
            if val[i]:
                loss -= np.log(p[y[i]])
            else:
                p[y[i]] -= 1
                grad += sum(n) / (k * n[y[i]]) * np.outer(p, row)
        pred = np.array(pred)
        f1 = [2 * ((pred == c) & (y == c) & val).sum() / max(1, ((pred == c) & val).sum() + ((y == c) & val).sum()) for c in range(k)]
        out.append((loss / val.sum(), float(np.mean(f1)), w.copy()))
        w = w - rate * grad / sum(n)
    return out


def test_history_equals_plain_loop(spark):
    rng = np.random.default_rng(3)
    y = np.r_[np.zeros(30, int), np.ones(18, int), np.full(12, 2)]
    x = rng.normal(size=(60, 2)) + np.array([[0, 0], [2, 0], [0, 2]])[y]
    x[5, 1] = np.nan
    val = np.arange(60) % 3 == 0
    rows = [("abc"[c], bool(v), float(a), None if np.isnan(b) else float(b)) for c, v, (a, b) in zip(y, val, x, strict=True)] + [(None, False, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "label string, is_val boolean, f double, g double").repartition(5)
    history, weights = descent.training_history(df, ["f", "g"], epochs=6)
    want = _plain(y, val, x, 6, 0.5)
    got = history.orderBy("epoch").collect()
    assert np.allclose([(r.val_loss, r.val_macro_f1) for r in got], [w[:2] for w in want])
    best = max(range(6), key=lambda k: (round(want[k][1], 12), k))
    assert np.allclose(weights, want[best][2])
    assert scores.best_epoch(history.withColumnRenamed("val_macro_f1", "macro_f1")).first().best_epoch == best + 1
    assert got[0].val_loss > got[-1].val_loss


def test_history_stops_and_takes_empty(spark):
    rows = spark.createDataFrame([("a", False, 1.0), ("b", False, -1.0), ("a", True, -1.0), ("b", True, 1.0)], "label string, is_val boolean, f double")
    history, _ = descent.training_history(rows, ["f"], epochs=20, patience=2)  # the first epoch's macro F1 is never reached again
    assert history.count() == 3
    history, weights = descent.training_history(rows.where("false"), ["f"])
    assert history.isEmpty() and weights.shape == (0, 2)


def test_slots_table_function(spark):
    clean.register_explode_slots(spark)
    wide = spark.range(3).select("id", *((F.when(F.lit(k) != 2, F.col("id") * 10.0 + k) if a == "y" else F.lit(float(k))).alias(f"p{k}_{a}") for k in range(1, 7) for a in "xy"))
    cells = ", ".join(f"p{k}_{a}" for k in range(1, 7) for a in "xy")
    got = {(r.id, r.slot): (r.x, r.y) for r in spark.sql(f"SELECT id, t.* FROM {{wide}}, LATERAL explode_slots({cells}) t", wide=wide).collect()}
    assert got == {(i, k): ((float(k), i * 10.0 + k) if k != 2 else (None, None)) for i in range(3) for k in range(1, 7)}
