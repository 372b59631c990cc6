"""Column functions of numbers, names, times and probability arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import LABELS

#: How a tactic may be written, and its folder and label.
TACTIC_NAMES = {"coordinated_attack": "Coordinated_Attack", "coordinated_defense": "Coordinated_Defense", "coordinated_defence": "Coordinated_Defense", "delayed_support": "Delayed_Support", "spacing_breakdown": "Spacing_Breakdown"}


def cosine(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    return (ux * vx + uy * vy) / (F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy))


def entropy_bits(probs: Column) -> Column:
    """Shannon entropy of an array of probabilities; zeros add nothing."""
    return -F.aggregate(probs, F.lit(0.0), lambda s, p: s + F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def entropy_norm(probs: Column) -> Column:
    """Entropy as a share of the most that so many classes can have."""
    return entropy_bits(probs) / F.greatest(F.log2(F.size(probs).cast("double")), F.lit(1e-9))


def slope(y: Column, t: Column) -> Column:
    """Least-squares slope per frame; 0 for fewer than two points (an aggregate)."""
    return F.coalesce(F.regr_slope(y, t), F.lit(0.0))


def quantile(v: Column, q: float) -> Column:
    """Exact quantile with linear interpolation (an aggregate)."""
    return F.percentile(v, F.lit(q))


def ratio_clip(a: Column, b: Column, bound: float = 50.0) -> Column:
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), a / (F.abs(b) + 1e-6)))


def wrap_angle(a: Column) -> Column:
    """Angle in (-pi, pi]."""
    pi = F.pi()
    wrapped = F.pmod(a + pi, 2 * pi) - pi
    return F.when(wrapped == -pi, pi).otherwise(wrapped)


def linspace_int(n: int, last: Column) -> Column:
    """n evenly spaced whole numbers from 0 to ``last``, cut down to integers."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i * last / max(1, n - 1)).cast("long"))


def video_key(name: Column) -> Column:
    """'(n)' or '(plain)' from a clip's file name, '?' if it isn't one."""
    hit = F.regexp_extract(name, r"videoplayback(?:\s*(\(\d+\)))?_clip", 0)
    number = F.regexp_extract(name, r"videoplayback(?:\s*(\(\d+\)))?_clip", 1)
    return F.when(hit == "", "?").when(number == "", "(plain)").otherwise(number)


def frame_number(stem: Column) -> Column:
    """Number after 'frame', else the first number, else null."""
    named, first = F.regexp_extract(stem, r"(?i)frame[_-]?(\d+)", 1), F.regexp_extract(stem, r"(\d+)", 1)
    return F.coalesce(F.when(named != "", named.try_cast("long")), F.when(first != "", first.try_cast("long")))


def canonical_tactic(name: Column) -> Column:
    """Folder name of a tactic however it is written; null if unknown."""
    key = F.regexp_replace(F.lower(F.trim(name)), " ", "_")
    return F.create_map(*(F.lit(x) for kv in TACTIC_NAMES.items() for x in kv))[key]


def hms_to_seconds(text: Column) -> Column:
    """Seconds of 'HH:MM:SS(.s)'; null if it isn't that."""
    part = F.split(F.trim(text), ":")
    value = part[0].try_cast("double") * 3600 + part[1].try_cast("double") * 60 + part[2].try_cast("double")
    return F.when(F.size(part) == 3, value)


def seconds_to_hms(seconds: Column) -> Column:
    """'HH:MM:SS.mmm'; less than zero is zero."""
    s = F.greatest(seconds, F.lit(0.0))
    return F.when(seconds.isNotNull(), F.format_string("%02d:%02d:%06.3f", F.floor(s / 3600).cast("int"), F.floor((s % 3600) / 60).cast("int"), s % 60))


def clip_name(video: Column, number: Column) -> Column:
    return F.concat(video, F.lit("_clip_"), F.lpad(number.cast("string"), 3, "0"))


def annotation_name(folder: Column, stem: Column) -> Column:
    return F.concat(folder, F.lit("__"), stem, F.lit(".csv"))


def label_index(label: Column) -> Column:
    """Number of a label; 0 for what is none."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))[label], F.lit(0))


def holdout_key(key: Column) -> Column:
    """'(1)' from '1' or '(1)'."""
    return F.when(key.startswith("("), key).otherwise(F.concat(F.lit("("), key, F.lit(")")))


def event_window(tactic: Column, t: Column) -> Column:
    """Interval of an event: around its time for defence, after it for the rest."""
    defence = tactic == "Coordinated_Defense"
    return F.struct(F.when(defence, t - 0.5).otherwise(t).alias("start_s"), F.when(defence, t + 0.5).otherwise(t + 1).alias("end_s"))


def argmax(probs: Column) -> Column:
    """Index from 0 of the first largest value."""
    return F.array_position(probs, F.array_max(probs)).cast("int") - 1


def confidence_label(probs: Column, names: Column, tau: float = 0.5) -> Column:
    """Name of the likeliest class, or 'Uncertain' below ``tau``."""
    return F.when(F.array_max(probs) >= tau, F.get(names, argmax(probs))).otherwise("Uncertain")
