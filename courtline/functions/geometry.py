"""Column functions of plane geometry; points are structs with x and y."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import COURT_H, COURT_W, NET_Y


def foot_point(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Where a box stands: the middle of its lower edge."""
    return F.struct(((x1 + x2) / 2).alias("x"), y2.alias("y"))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def _gap(p: Column, q: Column) -> Column:
    return distance(p["x"], p["y"], q["x"], q["y"])


def mean_of(values: Column) -> Column:
    """Mean of an array of doubles; null if it is empty."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values))


def nearest_distances(points: Column) -> Column:
    """Each point's distance to its nearest other one (points have slot, x, y)."""
    return F.transform(points, lambda p: F.array_min(F.transform(F.filter(points, lambda q: q["slot"] != p["slot"]), lambda q: _gap(p, q))))


def pair_distances(points: Column) -> Column:
    """Distances of all pairs of points (slot, x, y)."""
    return F.flatten(F.transform(points, lambda p: F.transform(F.filter(points, lambda q: q["slot"] > p["slot"]), lambda q: _gap(p, q))))


def hull_area(points: Column) -> Column:
    """Area of the convex hull of a few points; 0 for fewer than three or collinear ones.

    A pair of points is a hull edge if every other point is on its left, or on it and between its
    ends; the area is half the sum of the edges' cross products. Points that coincide count once.
    """
    own = F.array_distinct(F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))

    def edge(p: Column, q: Column) -> Column:
        def fits(k: Column) -> Column:
            cross = (q["x"] - p["x"]) * (k["y"] - p["y"]) - (q["y"] - p["y"]) * (k["x"] - p["x"])
            between = (k["x"] - p["x"]) * (k["x"] - q["x"]) + (k["y"] - p["y"]) * (k["y"] - q["y"]) <= 0
            return (k == p) | (k == q) | (cross > 0) | ((cross == 0) & between)

        return (p != q) & F.forall(own, fits)

    parts = F.flatten(F.transform(own, lambda p: F.transform(F.filter(own, lambda q: edge(p, q)), lambda q: p["x"] * q["y"] - q["x"] * p["y"])))
    return F.when(F.size(own) < 3, F.lit(0.0)).otherwise(F.abs(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)) / 2)


def quad_signed_distance(px: Column, py: Column, corners: Column) -> Column:
    """Distance of a point to the nearest edge of a quad (array of four points); positive inside."""
    edges = F.transform(corners, lambda p, i: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), F.element_at(corners, (i + 1) % 4 + 1)["x"].alias("bx"), F.element_at(corners, (i + 1) % 4 + 1)["y"].alias("by")))

    def along(e: Column) -> Column:
        ex, ey = e["bx"] - e["ax"], e["by"] - e["ay"]
        size = ex * ex + ey * ey
        t = F.when(size > 0, ((px - e["ax"]) * ex + (py - e["ay"]) * ey) / size).otherwise(0.0)
        return F.struct(e["ax"].alias("ax"), e["ay"].alias("ay"), ex.alias("ex"), ey.alias("ey"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)).alias("t"))

    def crosses(e: Column) -> Column:
        spans = (e["ay"] > py) != (e["by"] > py)
        return spans & ((px - e["ax"]) * F.abs(e["by"] - e["ay"]) < (e["bx"] - e["ax"]) * (py - e["ay"]) * F.signum(e["by"] - e["ay"]))

    least = F.array_min(F.transform(F.transform(edges, along), lambda e: distance(px, py, e["ax"] + e["t"] * e["ex"], e["ay"] + e["t"] * e["ey"])))
    inside = F.size(F.filter(edges, crosses)) % 2 == 1
    return F.when(inside, least).otherwise(-least)


def apply_homography(h: Column, px: Column, py: Column) -> Column:
    """Project a point by the nine coefficients of a homography (row by row)."""
    w = h[6] * px + h[7] * py + h[8]
    return F.struct(((h[0] * px + h[1] * py + h[2]) / w).alias("x"), ((h[3] * px + h[4] * py + h[5]) / w).alias("y"))


def linear_scale(px: Column, py: Column, width: Column, height: Column) -> Column:
    """Pixels to court centimetres by the frame's size alone."""
    return F.struct((px / width * COURT_W).alias("x"), (py / height * COURT_H).alias("y"))


def order_corners(corners: Column) -> Column:
    """Four points as top left, top right, bottom right, bottom left, by extremes of sum and difference."""

    def pick(key, first: bool) -> Column:
        ranked = F.array_sort(F.transform(corners, lambda p: F.struct(key(p).alias("k"), p["x"].alias("x"), p["y"].alias("y"))))
        p = F.element_at(ranked, 1 if first else -1)
        return F.struct(p["x"].alias("x"), p["y"].alias("y"))

    total, slant = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.array(pick(total, True), pick(slant, True), pick(total, False), pick(slant, False))


def net_distance(y: Column, side: str = "bottom") -> Column:
    """Signed distance from the net into one's own half."""
    return y - NET_Y if side == "bottom" else NET_Y - y


def geometric_team(y: Column, margin: float = 0.0) -> Column:
    """Half of the court a foot stands in; missing or inside the margin is UNKNOWN."""
    return F.when(y >= NET_Y + margin, "NEAR").when(y <= NET_Y - margin, "FAR").otherwise("UNKNOWN")


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (structs x1, y1, x2, y2)."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return w * h / (area(a) + area(b) - w * h + 1e-9)


def apply_affine(m: Column, corners: Column) -> Column:
    """A 2x3 affine map (six numbers, row by row) of an array of points."""
    return F.transform(corners, lambda p: F.struct((m[0] * p["x"] + m[1] * p["y"] + m[2]).alias("x"), (m[3] * p["x"] + m[4] * p["y"] + m[5]).alias("y")))
