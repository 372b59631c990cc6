"""Queries of channel importance, calibration and scoring with a saved model."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import clean, court, descent, models, scores
from ..operators.stored import shared_folder
from .base import CLIP_FRAME, POS, Query, R, positions, rounded
from .formation import _METRICS
from .learning import _clips

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: One channel for each metric of a clip.
_CHANNELS = {m: (m,) for m in _METRICS}


def _score(s, d):
    """Matches in two halves: a model of each is saved, loaded and applied to the clips of the other one."""
    clips, parts = _clips(s, d).withColumn("half", F.col("match_id") % 2), []
    for half in (0, 1):
        path = f"{shared_folder(s)}/bundle-{uuid.uuid4().hex}"
        models.save_bundle(s, models.fit_bundle(clips.where(F.col("half") != half), _METRICS, "tree"), path)
        parts.append(models.batch_score(clips.where(F.col("half") == half), models.load_bundle(s, path, "1")))
    return parts[0].unionByName(parts[1]).select("clip", "label", "confidence", "entropy", "entropy_norm", "is_anomaly")


QUERIES["ml7_permutation_importance"] = lambda s, d: rounded(models.channel_importance(_clips(s, d), _CHANNELS, "video"))
QUERIES["top4_importance_top"] = lambda s, d: rounded(models.channel_importance(_clips(s, d), _CHANNELS, "video", top=3))
QUERIES["ml6_calibrate"] = lambda s, d: models.calibrate(_clips(s, d), _METRICS).select("clip", "y_true", "y_pred", "calibrated", "folds")
QUERIES["ml9_batch_score"] = lambda s, d: rounded(_score(s, d))


def _verdicts(s, d):
    """Matches in two halves: the windows of each are scored by the model of the other one."""
    clips = _clips(s, d).withColumn("half", F.col("match_id") % 2)
    parts = [models.batch_score(clips.where(F.col("half") == v), models.fit_bundle(clips.where(F.col("half") != v), _METRICS, "tree")) for v in (0, 1)]
    return court.window_verdicts(X.raw_positions(s, d, dealt=True), scored=parts[0].unionByName(parts[1]), dealt=True)


def _history(s, d):
    """Each epoch's figures, every fourth match left for validation, and which epoch is the best."""
    rows = _clips(s, d).withColumn("is_val", F.col("match_id") % 4 == 0)
    history, _ = descent.training_history(rows, _METRICS)
    best = scores.best_epoch(history.withColumnRenamed("val_macro_f1", "macro_f1")).select("best_epoch")
    return history.join(F.broadcast(best)).withColumn("is_best", F.col("epoch") == F.col("best_epoch")).drop("best_epoch")


def _slots(s, d):
    clean.register_explode_slots(s)
    cells = ", ".join(f"p{k}_{a}" for k in range(1, 7) for a in "xy")
    return s.sql(f"SELECT match_id, sequence, frame_id, t.slot, t.x, t.y FROM {{wide}}, LATERAL explode_slots({cells}) t", wide=clean.long_to_wide(positions(s, d), CLIP_FRAME))


QUERIES["ana14_model_verdict"] = lambda s, d: rounded(_verdicts(s, d))
QUERIES["ml11_training_history"] = lambda s, d: rounded(_history(s, d))
QUERIES["udtf_explode_slots"] = lambda s, d: rounded(_slots(s, d))
ORACLE_SQL["udtf_explode_slots"] = f"WITH {POS} SELECT match_id, sequence, frame_id, slot, {R('x')} AS x, {R('y')} AS y FROM pos"
