"""Boxes: structs of left, top, width and height, within 0 and 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return b["width"] * b["height"]


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where they do not meet."""
    w = F.least(a["left"] + a["width"], b["left"] + b["width"]) - F.greatest(a["left"], b["left"])
    h = F.least(a["top"] + a["height"], b["top"] + b["height"]) - F.greatest(a["top"], b["top"])
    both = F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def padded(b: Column, share: float = 0.1) -> Column:
    """Grown by a share of its size on each side, cut at the image's edge."""
    left, top = F.greatest(F.lit(0.0), b["left"] - share * b["width"]), F.greatest(F.lit(0.0), b["top"] - share * b["height"])
    right, bottom = F.least(F.lit(1.0), b["left"] + (1 + share) * b["width"]), F.least(F.lit(1.0), b["top"] + (1 + share) * b["height"])
    return F.struct(left.alias("left"), top.alias("top"), (right - left).alias("width"), (bottom - top).alias("height"))


def from_centre(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return F.struct((cx - w / 2).alias("left"), (cy - h / 2).alias("top"), w.alias("width"), h.alias("height"))


def of_polygon(xs: Column, ys: Column) -> Column:
    """The box around a polygon's corners."""
    left, top = F.array_min(xs), F.array_min(ys)
    return F.struct(left.alias("left"), top.alias("top"), (F.array_max(xs) - left).alias("width"), (F.array_max(ys) - top).alias("height"))
