"""Box arithmetic as Column expressions.

A box is a tuple of four columns (x1, y1, x2, y2). ``least``/``greatest`` skip NULLs, so
after an outer join callers must check that the other side is present.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]

def box(prefix: str = "") -> Box:
    """Corner columns ``{prefix}x1`` .. ``{prefix}y2``."""
    return tuple(F.col(prefix + c) for c in ("x1", "y1", "x2", "y2"))


def from_ltwh(left: Column, top: Column, width: Column, height: Column) -> Box:
    """Corner form of a left/top/width/height box."""
    return left, top, left + width, top + height


def area(b: Box) -> Column:
    """Area; a side that runs backwards counts as zero."""
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def signed_area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def center(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def overlaps(a: Box, b: Box) -> Column:
    """True when the intersection has positive area."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def intersection(a: Box, b: Box) -> Column:
    width = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    height = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), width) * F.greatest(F.lit(0.0), height)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, 0 for an empty union."""
    inter = intersection(a, b)
    union = signed_area(a) + signed_area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def ioa(a: Box, b: Box) -> Column:
    """Intersection over the area of ``a``, 0 for an empty ``a``."""
    return F.when(signed_area(a) > 0, intersection(a, b) / signed_area(a)).otherwise(F.lit(0.0))


def center_distance(a: Box, b: Box) -> Column:
    (ax, ay), (bx, by) = center(a), center(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))
