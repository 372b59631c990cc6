"""Registered queries against their SQL twins on the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: One or two of each family; the driver runs them all.
CHOSEN = ("agg1_team_descriptor", "agg4_window_metrics", "agg8_invariant_features", "win2_gap_interpolate", "ana5_label_clip", "agg10_label_report", "ana11_infer_roles", "stf4_team_vote", "ana17_preflight_verdict", "agg14_classification_scores", "ana22_stratified_split", "jn3_event_interval_join", "agg26_density_smooth", "ana21_temporal_split", "geo11_iou", "mth2_entropy", "scl4_hms_seconds", "flt12_static_hotspot_filter", "jn14_knn_join", "jn4_calibration_asof", "scl8_label_line_parse")


def _plain(v):
    v = float(v) if isinstance(v, Decimal) else v
    return "nan" if isinstance(v, float) and math.isnan(v) else v


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, sf_dir, name):
    if not os.path.isdir(sf_dir):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(_plain(v) for v in r)) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(_plain(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).columns[:3] == ["match_id", "sequence", "frame_id"]
