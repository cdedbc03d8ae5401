"""Rectangle arithmetic on columns x0, y0, x1, y1, with an optional prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(p: str = "") -> Column:
    side = lambda a, b: F.greatest(F.lit(0.0), F.col(p + b) - F.col(p + a))
    return side("x0", "x1") * side("y0", "y1")


def iou(p: str, q: str) -> Column:
    w = F.least(F.col(p + "x1"), F.col(q + "x1")) - F.greatest(F.col(p + "x0"), F.col(q + "x0"))
    h = F.least(F.col(p + "y1"), F.col(q + "y1")) - F.greatest(F.col(p + "y0"), F.col(q + "y0"))
    both = F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)
    union = area(p) + area(q) - both
    return F.when((w > 0) & (h > 0) & (union > 0), both / union).otherwise(0.0)


def overlaps(p: str, q: str) -> Column:
    return (F.col(p + "x0") < F.col(q + "x1")) & (F.col(q + "x0") < F.col(p + "x1")) & (F.col(p + "y0") < F.col(q + "y1")) & (F.col(q + "y0") < F.col(p + "y1"))


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high) if not isinstance(high, Column) else high, c))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """By Rec. 709."""
    return 0.2126 * r + 0.7152 * g + 0.0722 * b
