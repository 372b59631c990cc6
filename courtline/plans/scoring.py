"""Queries of scores, weights, samples and splits, over labelled documents as clips."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..constants import TACTICS
from ..operators import scores as O
from .base import Query, R, rounded

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_PRED = """SELECT l.doc_id AS clip, d.source AS video_key, t.label AS y_true,
  CASE WHEN d.n_chars % 4 = 0 THEN u.label ELSE t.label END AS y_pred
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id
JOIN (SELECT 0 AS k, 'Spacing Breakdown' AS label UNION ALL SELECT 1, 'Delayed Support' UNION ALL SELECT 2, 'Coordinated Attack' UNION ALL SELECT 3, 'Coordinated Defense') t ON t.k = CASE WHEN l.doc_id % 3 = 0 THEN l.quality * 2 + l.toxic ELSE 2 + l.doc_id % 2 END
JOIN (SELECT 0 AS k, 'Spacing Breakdown' AS label UNION ALL SELECT 1, 'Delayed Support' UNION ALL SELECT 2, 'Coordinated Attack' UNION ALL SELECT 3, 'Coordinated Defense') u ON u.k = d.n_chars % 3"""
SQL = f"p AS ({_PRED.replace('{', '').replace('}', '')})"
_PC = f"""{SQL}, lab AS (SELECT y_true AS label, count(*) AS support, 0 AS predicted, 0 AS hit FROM p GROUP BY 1 UNION ALL SELECT y_pred, 0, count(*), sum(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) FROM p GROUP BY 1),
s0 AS (SELECT label, CAST(sum(support) AS BIGINT) AS support, CAST(sum(predicted) AS BIGINT) AS predicted, CAST(sum(hit) AS BIGINT) AS hit FROM lab GROUP BY 1),
pc AS (SELECT *, CASE WHEN predicted > 0 THEN hit / CAST(predicted AS DOUBLE) ELSE 0 END AS precision_, CASE WHEN support > 0 THEN hit / CAST(support AS DOUBLE) ELSE 0 END AS recall_, 2 * hit / CAST(support + predicted AS DOUBLE) AS f1 FROM s0)"""


def predictions(s, d):
    return s.sql(_PRED, **X.tables(s, d, "labels", "documents"))


def _labelled(s, d):
    return predictions(s, d).select("clip", "video_key", F.col("y_true").alias("label"))


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


_name = lambda c: c.lower().replace(" ", "_")
_every = "every AS (SELECT * FROM (VALUES ('Coordinated Attack'), ('Coordinated Defense'), ('Delayed Support'), ('Spacing Breakdown'), ('Unclassified')) v(label))"
_add("agg13_confusion_matrix", lambda s, d: rounded(O.confusion_matrix(predictions(s, d))), f"WITH {SQL}, {_every} SELECT e.label AS y_true, " + ", ".join(f"count(CASE WHEN y_pred = '{c}' THEN 1 END) AS {_name(c)}" for c in TACTICS) + f", count(y_true) AS support, {R('CASE WHEN count(y_true) > 0 THEN count(CASE WHEN y_pred = y_true THEN 1 END) / CAST(count(y_true) AS DOUBLE) ELSE 0 END')} AS recall FROM every e LEFT JOIN p ON p.y_true = e.label WHERE e.label <> 'Unclassified' GROUP BY 1")
_KAPPA = "(sum(hit) / CAST(sum(support) AS DOUBLE) - sum(support * predicted) / (CAST(sum(support) AS DOUBLE) * sum(support))) / (1 - sum(support * predicted) / (CAST(sum(support) AS DOUBLE) * sum(support)))"
_SCORES = f"SELECT {R('sum(hit) / CAST(sum(support) AS DOUBLE)')} AS accuracy, {R('avg(CASE WHEN support > 0 THEN recall_ END)')} AS balanced_accuracy, {R('avg(f1)')} AS macro_f1, {R('sum(f1 * support) / sum(support)')} AS weighted_f1, {R(_KAPPA)} AS cohen_kappa, CAST(sum(support) AS BIGINT) AS n FROM pc"
_add("agg14_classification_scores", lambda s, d: rounded(O.classification_scores(predictions(s, d))), f"WITH {_PC} {_SCORES}")
_add("agg15_fixed_k_scores", lambda s, d: rounded(O.fixed_class_scores(predictions(s, d), (*TACTICS, "Unclassified"))), f"WITH {_PC} SELECT {R('sum(hit) / CAST(sum(support) AS DOUBLE)')} AS accuracy, {R('sum(f1) / 5')} AS macro_f1, {R('sum(recall_) / 5')} AS balanced_acc FROM pc")
_add("agg16_per_class_report", lambda s, d: rounded(O.class_report(predictions(s, d))), f"WITH {_PC} SELECT label, {R('precision_')} AS precision, {R('recall_')} AS recall, {R('f1')} AS f1, support FROM pc UNION ALL SELECT 'macro avg', {R('avg(precision_)')}, {R('avg(recall_)')}, {R('avg(f1)')}, CAST(sum(support) AS BIGINT) FROM pc UNION ALL SELECT 'weighted avg', {R('sum(precision_ * support) / sum(support)')}, {R('sum(recall_ * support) / sum(support)')}, {R('sum(f1 * support) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM pc")
_MODE = _PC.replace(SQL, f"{SQL.replace('p AS', 'p0 AS', 1)}, p AS (SELECT clip, y_true, (SELECT y_true FROM p0 GROUP BY 1 ORDER BY count(*) DESC, y_true LIMIT 1) AS y_pred FROM p0)")
_add("agg17_majority_baseline", lambda s, d: rounded(O.majority_baseline(predictions(s, d))), f"WITH {_MODE} {_SCORES}")
_add("agg18_class_weights", lambda s, d: rounded(O.class_weights(_labelled(s, d), (*TACTICS, "Unclassified"))), f"WITH {SQL}, {_every}, c AS (SELECT e.label, count(y_true) AS n FROM every e LEFT JOIN p ON p.y_true = e.label GROUP BY 1), a AS (SELECT avg(CASE WHEN n > 0 THEN 1.0 / n END) AS m FROM c) SELECT label, n, {R('CASE WHEN n > 0 THEN least(4.0, CAST(1 AS DOUBLE) / n / m) ELSE 0 END')} AS weight FROM c, (SELECT avg(CASE WHEN n > 0 THEN CAST(1 AS DOUBLE) / n END) AS m FROM c) a2")
_PLACE = "row_number() OVER (PARTITION BY y_true ORDER BY md5('7:' || CAST(clip AS VARCHAR)), clip)"
_FOLDS = f"{SQL}, fo AS (SELECT clip, y_true AS label, CAST(({_PLACE} - 1) % 5 AS INTEGER) AS fold FROM p)"
_add("ml4_kfold_assign", lambda s, d: O.kfold(_labelled(s, d)).select("clip", "label", F.col("fold").cast("int").alias("fold")), f"WITH {_FOLDS} SELECT clip, label, fold FROM fo")
_add("ml3_balanced_weights", lambda s, d: rounded(O.balanced_weights(O.kfold(_labelled(s, d)).withColumn("fold", F.col("fold").cast("int")), ("fold",))), f"WITH {_FOLDS}, k AS (SELECT fold, label, count(*) AS n_k FROM fo GROUP BY 1, 2) SELECT fold, label, n_k, {R('sum(n_k) OVER (PARTITION BY fold) / CAST(count(*) OVER (PARTITION BY fold) * n_k AS DOUBLE)')} AS weight FROM k")
_add("top6_balanced_sample", lambda s, d: O.balanced_sample(_labelled(s, d), 10).select("clip", "label", F.col("place").cast("long").alias("place")), f"WITH {SQL}, b AS (SELECT clip, y_true AS label, {_PLACE} AS k FROM p) SELECT clip, label, row_number() OVER (ORDER BY md5('8:' || CAST(clip AS VARCHAR)), clip) AS place FROM b WHERE k <= 10")
_add("ana22_stratified_split", lambda s, d: O.stratified_split(_labelled(s, d)).select("clip", "label", "split"), f"""WITH {SQL}, b AS (SELECT clip, y_true AS label, {_PLACE} AS k, count(*) OVER (PARTITION BY y_true) AS n FROM p),
c AS (SELECT *, greatest(floor(n * 0.15), CASE WHEN n >= 3 THEN 1 ELSE 0 END) AS nt FROM b) SELECT clip, label, CASE WHEN k <= nt THEN 'test' WHEN k <= nt + CASE WHEN n - 2 * nt < 1 THEN greatest(0, nt - (1 - (n - 2 * nt))) ELSE nt END THEN 'val' ELSE 'train' END AS split FROM c""")
_add("ana23_holdout_split", lambda s, d: O.holdout_split(_labelled(s, d).withColumn("video_key", F.concat(F.lit("("), F.regexp_extract("video_key", r"\d+", 0), F.lit(")"))), "3").select("clip", "video_key", "split"), f"WITH {SQL} SELECT clip, '(' || regexp_extract(video_key, '\\d+') || ')' AS video_key, CASE WHEN video_key = 'src3' THEN 'test' ELSE 'train' END AS split FROM p")
_GOLD = "SELECT CAST(o_custkey AS STRING) AS clip, CASE o_orderkey % 3 WHEN 0 THEN 'Unclear' WHEN 1 THEN 'Coordinated Attack' ELSE 'Delayed Support' END AS label, o_clerk AS annotator, o_orderdate AS labelled_at, o_orderkey FROM {orders}"
_gsql = f"g AS ({_GOLD.replace('{', '').replace('}', '').replace('STRING', 'VARCHAR')})"


def _gold(s, d):
    o = X.tables(s, d, "orders")["orders"]
    clerk = "o_clerk" if "o_clerk" in o.columns else "CAST(o_orderkey AS STRING)"
    return s.sql(_GOLD.replace("o_clerk", clerk), orders=o)


_gsql = _gsql.replace("o_clerk", "CAST(o_orderkey AS VARCHAR)")
_add("snk6_gold_upsert", lambda s, d: O.gold_latest(_gold(s, d).withColumn("annotator", F.col("o_orderkey").cast("string"))).select("clip", "label", "annotator"), f"WITH {_gsql}, r AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY labelled_at DESC, annotator) AS k FROM g) SELECT clip, label, annotator FROM r WHERE k = 1")
_add("jn2_label_todo", lambda s, d: O.label_todo(s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("clip")), _gold(s, d)), f"WITH {_gsql} SELECT CAST(c_custkey AS VARCHAR) AS clip FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT clip FROM g)")


def _gold_join(s, d):
    p = predictions(s, d)
    gold = p.select("clip", F.when(F.col("clip") % 7 == 0, "Unclear").otherwise(F.col("y_true")).alias("gold")).where(F.col("clip") % 2 == 0)
    return gold.join(p, "clip").where(F.col("gold").isin(*TACTICS)).select("clip", "gold", "y_true", "y_pred")


_add("jn1_gold_join", _gold_join, f"WITH {SQL} SELECT clip, y_true AS gold, y_true, y_pred FROM p WHERE clip % 2 = 0 AND clip % 7 <> 0")
_add("ml8_gold_evaluation", lambda s, d: rounded(O.classification_scores(_gold_join(s, d).select(F.col("gold").alias("y_true"), "y_pred"))), f"WITH {_PC.replace(SQL, SQL + ', q AS (SELECT * FROM p WHERE clip % 2 = 0 AND clip % 7 <> 0)').replace('FROM p GROUP', 'FROM q GROUP')} {_SCORES}")
_MODELS = "SELECT video_key AS model, CASE WHEN length(video_key) = 4 THEN 'absolute' ELSE 'invariant' END AS mode, y_true, y_pred FROM"
_FP = f"{SQL}, k AS ({_MODELS} p), l2 AS (SELECT model, mode, y_true AS label, count(*) AS support, 0 AS predicted, 0 AS hit FROM k GROUP BY 1, 2, 3 UNION ALL SELECT model, mode, y_pred, 0, count(*), sum(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) FROM k GROUP BY 1, 2, 3), l3 AS (SELECT model, mode, label, 2 * sum(hit) / CAST(sum(support) + sum(predicted) AS DOUBLE) AS f1 FROM l2 GROUP BY 1, 2, 3), ms AS (SELECT model, mode, {R('avg(f1)')} AS macro_f1 FROM l3 GROUP BY 1, 2)"


def _model_scores(s, d):
    p = predictions(s, d).select(F.col("video_key").alias("model"), F.when(F.length("video_key") == 4, "absolute").otherwise("invariant").alias("mode"), "y_true", "y_pred")
    return rounded(O.classification_scores(p, ("model", "mode")), "model", "mode", "macro_f1")


_add("top3_model_ranking", lambda s, d: O.model_ranking(_model_scores(s, d)).select("model", "macro_f1", F.col("rank").cast("long").alias("rank")), f"WITH {_FP} SELECT model, macro_f1, row_number() OVER (ORDER BY macro_f1 DESC, model) AS rank FROM ms")
_add("agg31_ablation_table", lambda s, d: rounded(O.ablation_table(_model_scores(s, d), "absolute")), f"WITH {_FP}, b AS (SELECT mode, model, macro_f1 FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY macro_f1 DESC, model) AS k FROM ms) q WHERE k = 1) SELECT mode, model, macro_f1, {R('macro_f1 - (SELECT macro_f1 FROM b WHERE mode = $$absolute$$)')} AS gain FROM b")
