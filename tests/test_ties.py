"""Values on a rounding's tie: rounded as SQL rounds, and not moved off the tie by the order of rows."""

import math
import random

import duckdb
import pytest

from courtline.operators import clips
from courtline.plans.base import r

NAMES = clips.MODEL_CHANNELS


def _sql_round(values, digits):
    return [x for (x,) in duckdb.connect().execute(f"SELECT round(x, {digits}) + 0 FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchall()]


@pytest.mark.parametrize("digits", [4, 5, 6])
def test_rounding_is_that_of_sql(spark, digits):
    rng = random.Random(digits)
    values = [float(f"{rng.choice('-+')}{10 * rng.randrange(10**7) + 5}e-{digits + 1}") for _ in range(2000)] + [rng.uniform(-900, 900) for _ in range(500)]
    got = [x.v for x in spark.createDataFrame(list(enumerate(values)), "i int, x double").select("i", r("x", digits).alias("v")).orderBy("i").collect()]
    assert got == _sql_round(values, digits)


def _clip(sequence, channel, values, rng):
    frames = [(1, sequence, 29_000 * sequence + t, *(v if n == channel else 1.5 for n in NAMES)) for t, v in enumerate(values)]
    rng.shuffle(frames)
    return frames


def _tied(rng, n=29):
    """Whole numbers of players whose spread is rational and whose lowest z-score lies on the tie of its fourth decimal."""
    while True:
        v = [rng.randrange(7) for _ in range(n)]
        d = n * sum(x * x for x in v) - sum(v) ** 2
        root = math.isqrt(d)
        if d and root * root == d and (10**4 * (n * min(v) - sum(v)) * 2) % root == 0 and (10**4 * (n * min(v) - sum(v)) * 2 // root) % 2:
            return [float(x) for x in v], (n * min(v) - sum(v)) / root


def test_shapes_on_a_tie(spark):
    rng = random.Random(3)
    made = [_tied(rng) for _ in range(25)]
    rows = [x for s, (v, _) in enumerate(made) for x in _clip(s, "n_present", v, rng)]
    table = spark.createDataFrame(rows, "match_id long, sequence long, frame_id long, " + ", ".join(f"{n} double" for n in NAMES)).repartition(5)
    got = {x.sequence: x.value for x in clips.invariant_features(table).where("feature = 'n_present__z_min'").collect()}
    assert got == {s: z for s, (_, z) in enumerate(made)}


def test_statistics_do_not_depend_on_order(spark):
    rng = random.Random(4)
    clip = {s: [rng.randrange(180_000) / 100 for _ in range(16)] for s in range(40)}
    schema = "match_id long, sequence long, frame_id long, " + ", ".join(f"{n} double" for n in NAMES)
    seen = []
    for _ in range(2):
        rows = [x for s, v in clip.items() for x in _clip(s, "ball_x", v, rng)]
        seen.append({x.sequence: x["mean"] for x in clips.absolute_features(spark.createDataFrame(rows, schema).repartition(4)).where("channel = 'ball_x'").collect()})
    assert seen[0] == seen[1] == {s: math.fsum(v) / 16 for s, v in clip.items()}


def test_quarters_keep_the_plain_statistics(spark):
    rng = random.Random(5)
    clip = {0: [rng.randrange(-40, 40) / 4 for _ in range(29)], 1: [2.25] * 29, 2: [7.0], 3: [rng.uniform(0, 9) for _ in range(29)], 4: [3e8 * (t % 3) for t in range(29)]}
    rows = [x for s, v in clip.items() for x in _clip(s, "ball_y", v, rng)]
    table = spark.createDataFrame(rows, "match_id long, sequence long, frame_id long, " + ", ".join(f"{n} double" for n in NAMES))
    got = {x.sequence: x for x in clips.absolute_features(table).where("channel = 'ball_y'").collect()}
    shapes = {(x.sequence, x.feature): x.value for x in clips.invariant_features(table).where("feature like 'ball\\_y\\_\\_z%'").collect()}
    for s, v in clip.items():
        n, mean, t0 = len(v), sum(v) / len(v), (len(v) - 1) / 2
        std = math.sqrt(sum((x - mean) ** 2 for x in v) / n)
        steep = sum((t - t0) * x for t, x in enumerate(v)) / sum((t - t0) ** 2 for t in range(n)) if n > 1 else 0.0
        want = {"mean": mean, "std": std, "min": min(v), "max": max(v), "slope": steep}
        assert all(math.isclose(got[s][c], x, rel_tol=1e-9, abs_tol=1e-9) for c, x in want.items())
        z = {"min": (min(v) - mean) / std, "max": (max(v) - mean) / std, "slope": steep / std, "iqr": got[s].iqr / std} if std else dict.fromkeys(clips.SHAPES, 0.0)
        assert all(math.isclose(shapes[s, f"ball_y__z_{c}"], x, rel_tol=1e-9, abs_tol=1e-9) for c, x in z.items())
