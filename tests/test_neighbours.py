"""Pruned neighbour search against brute force."""

import numpy as np
import pytest

from courtline.operators import neighbours


def _brute(q, rows, k):
    out = set()
    for name, v in q:
        d = sorted((float(((np.array(v) - np.array(r[2])) ** 2).sum()), r[0], r[1]) for r in rows if r[0] != name and r[2] is not None and r[0] is not None)
        out |= {(name, i, label, round(d2, 9), rank) for rank, (d2, i, label) in enumerate(d[:k], 1)}
    return out


def _frames(spark, rows, q):
    return spark.createDataFrame(q, "vec_id long, embedding array<float>"), spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)


@pytest.mark.parametrize(("clusters", "slice_rows", "block"), [(12, 20_000, 4096), (1, 37, 11), (0, 50, 4096)])
def test_same_neighbours_as_brute_force(spark, monkeypatch, clusters, slice_rows, block):
    monkeypatch.setattr(neighbours, "SLICE", slice_rows)
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(clusters)
    centres = rng.normal(0, 30, (max(1, clusters), 6))
    points = centres[rng.integers(0, len(centres), 600)] + rng.normal(0, 1, (600, 6)) if clusters else rng.integers(0, 3, (600, 6)).astype(float)  # without clusters: a grid full of ties and copies
    points = points.astype(np.float32)
    rows = [(i, i % 4, p.tolist()) for i, p in enumerate(points)] + [(9999, 1, None), (None, 1, points[0].tolist())]
    q = [(i, points[i].tolist()) for i in range(0, 600, 20)] + [(-1, rng.normal(0, 100, 6).astype(np.float32).tolist()), (-2, None)]
    queries, table = _frames(spark, rows, q)
    got = {(r.query_id, r.vec_id, r.label, round(r.d2, 9), r.rank) for r in neighbours.knn(queries, table, 5).collect()}
    assert got == _brute([x for x in q if x[1] is not None], rows, 5)
    if clusters == 12:  # cells that are visited hold under a fifth of all pairs
        cells = neighbours.Cells(table)
        own = queries.where("embedding is not null and vec_id >= 0").selectExpr("vec_id query_id", "cast(embedding as array<double>) embedding")
        kth = spark.createDataFrame([(n, d) for n, _, _, d, rank in got if rank == 5], "query_id long, d2 double")
        visits = [r.cell for further in (False, True) for r in cells.visits(own.join(kth, "query_id"), 5, further).collect()]
        assert cells.count[visits].sum() < 0.2 * 600 * 30


def test_few_rows(spark):
    rows = [(1, 0, [0.0, 1.0]), (2, 1, [3.0, 1.0]), (3, 1, [3.0, 1.0])]
    queries, table = _frames(spark, rows, [(1, [0.0, 1.0]), (7, [3.0, 1.0])])
    got = {(r.query_id, r.vec_id, r.label, round(r.d2, 9), r.rank) for r in neighbours.knn(queries, table, 5).collect()}
    assert got == _brute([(1, [0.0, 1.0]), (7, [3.0, 1.0])], rows, 5)
    assert neighbours.knn(queries, table.where("false")).count() == 0 and neighbours.knn(queries.where("false"), table).count() == 0
    votes = {r.query_id: r.label for r in neighbours.knn_vote(neighbours.knn(queries, table, 5)).collect()}
    assert votes == {1: 1, 7: 1}


def test_centres_are_bounded(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [5.0, 5.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    centres = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [2.0, 1.0]), ("c", [5.0, 6.0])], "team string, centre array<double>")
    got = {r.vec_id: (r.team, r.d2) for r in neighbours.nearest_centre(rows, centres).collect()}
    assert got == {1: ("a", 0.0), 2: ("c", 1.0), 3: ("a", 1.0)}
    with pytest.raises(ValueError, match="more than 2 centres"):
        neighbours.nearest_centre(rows, centres, 2)
