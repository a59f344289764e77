"""Box geometry as column expressions; all of it stays in whole-stage codegen.

Boxes are structs or four columns ``x1, y1, x2, y2`` of doubles, in pixels.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*[F.col(f"{prefix}{c}") for c in cls._fields])

    def named(self) -> dict[str, Column]:
        return dict(zip(self._fields, self, strict=True))


def area(b: Box) -> Column:
    return F.greatest(b.x2 - b.x1, F.lit(0.0)) * F.greatest(b.y2 - b.y1, F.lit(0.0))


def size_bucket(a: Column) -> Column:
    return F.when(a < 32 * 32, "small").when(a < 96 * 96, "medium").otherwise("large")


def is_degenerate(b: Box) -> Column:
    return (b.x2 <= b.x1) | (b.y2 <= b.y1)


def overlap(a: Box, b: Box) -> Column:
    return F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.lit(0.0)) * F.greatest(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1), F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; the union is at least 1e-9."""
    common = overlap(a, b)
    return common / F.greatest(area(a) + area(b) - common, F.lit(1e-9))


def clamp(b: Box, width: Column, height: Column) -> tuple[Box, Column]:
    """The box inside the image, and whether it is one: false if a coordinate is null or nothing is left.

    Least corners go to [0, side - 1], greatest ones to [0, side].
    """
    whole = b.x1.isNotNull() & b.y1.isNotNull() & b.x2.isNotNull() & b.y2.isNotNull()
    keep = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most.cast("double")))
    out = Box(keep(b.x1, width - 1), keep(b.y1, height - 1), keep(b.x2, width), keep(b.y2, height))
    return out, whole & ~is_degenerate(out)


def clamp_all(b: Box, width: Column, height: Column) -> tuple[Box, Column]:
    """All corners to [0, side]; whether the box still has an area."""
    keep = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most.cast("double")))
    out = Box(keep(b.x1, width), keep(b.y1, height), keep(b.x2, width), keep(b.y2, height))
    return out, ~is_degenerate(out)


def clip_sorted(b: Box, width: Column, height: Column, least_side: float = 1.0) -> tuple[Box, Column]:
    """Clip, put each axis' two values in order, and say whether both sides reach ``least_side``."""
    c, _ = clamp_all(b, width, height)
    out = Box(F.least(c.x1, c.x2), F.least(c.y1, c.y2), F.greatest(c.x1, c.x2), F.greatest(c.y1, c.y2))
    return out, (out.x2 - out.x1 >= least_side) & (out.y2 - out.y1 >= least_side)


def to_center(b: Box, width: Column, height: Column) -> dict[str, Column]:
    """Normalised centre and size."""
    return {"cx": (b.x1 + b.x2) / 2 / width, "cy": (b.y1 + b.y2) / 2 / height, "w": (b.x2 - b.x1) / width, "h": (b.y2 - b.y1) / height}


def from_center(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Box:
    return Box((cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height)


def to_pixels(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Box:
    """Whole pixels, cut toward zero and then clipped."""
    b = from_center(cx, cy, w, h, width, height)
    clip = lambda v, most: F.greatest(F.lit(0), F.least(v.cast("int"), most.cast("int")))
    return Box(clip(b.x1, width), clip(b.y1, height), clip(b.x2, width), clip(b.y2, height))


def letterbox(b: Box, width: Column, height: Column, size: int) -> Box:
    """The box in a square image of ``size`` that holds the scaled image in its middle."""
    scale = F.least(F.lit(float(size)) / width, F.lit(float(size)) / height)
    pad = lambda side: F.floor((F.lit(size) - F.bround(side * scale)) / 2)
    dx, dy = pad(width), pad(height)
    return Box(b.x1 * scale + dx, b.y1 * scale + dy, b.x2 * scale + dx, b.y2 * scale + dy)


def to_text(b: Box) -> Column:
    """Four rounded numbers, half to even; empty for a null box."""
    whole = b.x1.isNotNull() & b.y1.isNotNull() & b.x2.isNotNull() & b.y2.isNotNull()
    return F.when(whole, F.concat_ws(" ", *[F.bround(v).cast("bigint").cast("string") for v in b])).otherwise("")
