"""Boxes, distances and coordinate spaces as column expressions.

Sheets have their origin at the top left and y grows downwards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Drawing units in an inch, and millimetres in one (fixed values).
UNITS_PER_INCH, MM_PER_INCH = 300.0, 25.4


def mm(length: float) -> float:
    """Millimetres in drawing units."""
    return length * UNITS_PER_INCH / MM_PER_INCH


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def rounded(value: Column, digits: int) -> Column:
    """Half-even rounding, the one rounding rule of the engine."""
    return F.bround(value, digits)


@dataclass(frozen=True)
class Box:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        """The box in columns x0, y0, x1, y1 with a prefix."""
        return cls(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))

    @classmethod
    def from_array(cls, box: Column) -> Box:
        return cls(*(F.get(box, F.lit(i)) for i in range(4)))

    def normalised(self) -> Box:
        return Box(F.least(self.x0, self.x1), F.least(self.y0, self.y1), F.greatest(self.x0, self.x1), F.greatest(self.y0, self.y1))

    def intersects(self, other: Box) -> Column:
        """Open overlap: boxes that only touch don't intersect."""
        a, b = self.normalised(), other.normalised()
        return (a.x0 < b.x1) & (a.x1 > b.x0) & (a.y0 < b.y1) & (a.y1 > b.y0)

    def center_inside(self, region: Box) -> Column:
        r, (x, y) = region.normalised(), self.center()
        return x.between(r.x0, r.x1) & y.between(r.y0, r.y1)

    def center(self) -> tuple[Column, Column]:
        return (self.x0 + self.x1) / 2, (self.y0 + self.y1) / 2

    def merged(self, other: Box) -> Box:
        return Box(F.least(self.x0, other.x0), F.least(self.y0, other.y0), F.greatest(self.x1, other.x1), F.greatest(self.y1, other.y1))

    def to_point(self, x: Column, y: Column) -> Column:
        """Distance of a point from the box; 0 inside."""
        zero = F.lit(0.0)
        dx, dy = F.greatest(self.x0 - x, zero, x - self.x1), F.greatest(self.y0 - y, zero, y - self.y1)
        return F.sqrt(dx * dx + dy * dy)

    def flipped(self, height: Column) -> Box:
        """Between y downwards and y upwards on a page of that height."""
        return Box(self.x0, height - self.y1, self.x1, height - self.y0)

    def array(self) -> Column:
        return F.array(self.x0, self.y0, self.x1, self.y1)

    def columns(self, prefix: str = "") -> dict[str, Column]:
        return {f"{prefix}{n}": c for n, c in (("x0", self.x0), ("y0", self.y0), ("x1", self.x1), ("y1", self.y1))}


def envelope(prefix: str = "", out: str = "") -> list[Column]:
    """Aggregates for the box around many."""
    return [F.min(f"{prefix}x0").alias(f"{out}x0"), F.min(f"{prefix}y0").alias(f"{out}y0"), F.max(f"{prefix}x1").alias(f"{out}x1"), F.max(f"{prefix}y1").alias(f"{out}y1")]


def page_height(view_box: Column) -> Column:
    """Height of a view box [x0, y0, x1, y1]."""
    return F.get(view_box, F.lit(3)) - F.get(view_box, F.lit(1))


def _affine(t: Column, x: Column, y: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = (F.get(t, F.lit(i)) for i in range(6))
    return a * x + c * y + e, b * x + d * y + f


def _inverse(t: Column, x: Column, y: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = (F.get(t, F.lit(i)) for i in range(6))
    det = a * d - b * c
    return (d * (x - e) - c * (y - f)) / det, (a * (y - f) - b * (x - e)) / det


def sheet_to_screen(box: Box, transform: Column, height: Column) -> Column:
    """A sheet box as a screen struct x, y, w, h; transform is [a, b, c, d, e, f] from y-up space."""
    up = box.flipped(height)
    (ax, ay), (bx, by) = _affine(transform, up.x0, up.y0), _affine(transform, up.x1, up.y1)
    return F.struct(F.least(ax, bx).alias("x"), F.least(ay, by).alias("y"), F.abs(bx - ax).alias("w"), F.abs(by - ay).alias("h"))


def screen_to_sheet(x: Column, y: Column, transform: Column, height: Column) -> tuple[Column, Column]:
    """A screen point on the sheet."""
    ux, uy = _inverse(transform, x, y)
    return ux, height - uy


def screen_rect_to_sheet(box: Box, transform: Column, height: Column) -> Box:
    """The sheet box around the four corners of a screen rectangle."""
    corners = [screen_to_sheet(x, y, transform, height) for x, y in ((box.x0, box.y0), (box.x1, box.y0), (box.x0, box.y1), (box.x1, box.y1))]
    xs, ys = zip(*corners, strict=True)
    return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))
