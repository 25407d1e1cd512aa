"""Lengths and areas of drawing entities (Column to Column), row by row, without exploding points."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import UNIT_METRES


def unit_factor(code: Column, measurement: Column) -> Column:
    """Metres per drawing unit; code 0 or unknown follows the measurement system."""
    out = F
    for k, v in UNIT_METRES.items():
        out = out.when(code == k, v)
    return out.when(measurement == 0, 0.3048).otherwise(0.001)


def line_length(x1: Column, y1: Column, x2: Column, y2: Column, dz: Column | None = None) -> Column:
    """Length in the plane, or in space where ``dz`` is given (null counts as 0)."""
    flat = (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)
    return F.sqrt(flat if dz is None else flat + F.coalesce(dz, F.lit(0.0)) * F.coalesce(dz, F.lit(0.0)))


def _segment(p: Column, q: Column, bulge: Column) -> Column:
    """Chord, or the arc over it: angle 4 atan |bulge|."""
    chord = line_length(p["x"], p["y"], q["x"], q["y"])
    angle = 4 * F.atan(F.abs(bulge))
    return F.when(F.coalesce(bulge, F.lit(0.0)) == 0, chord).otherwise(F.when(chord == 0, 0.0).otherwise(chord / (2 * F.sin(angle / 2)) * angle))


def polyline_length(points: Column, closed: Column) -> Column:
    """Sum of segments (with bulges); a closed line of three points or more returns to its start."""
    n = F.size(points)
    steps = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: _segment(F.get(points, i), F.get(points, i + 1), F.get(points, i)["bulge"]))
    total = F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)
    back = _segment(F.get(points, n - 1), F.get(points, F.lit(0)), F.get(points, n - 1)["bulge"])
    return F.when(n < 2, 0.0).otherwise(total + F.when(closed & (n >= 3), back).otherwise(0.0))


def arc_length(radius: Column, start: Column, end: Column, circle: Column) -> Column:
    """Arc from start to end degrees (once round if it ends before it starts), or a circle."""
    angle = F.radians(end) - F.radians(start)
    return F.when(circle, 2 * F.pi() * radius).otherwise(radius * F.when(angle < 0, angle + 2 * F.pi()).otherwise(angle))


def ring_area(points: Column) -> Column:
    """Absolute shoelace area of one path of three points or more."""
    n = F.size(points)
    parts = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.get(points, i)["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * F.get(points, i)["y"])
    return F.when(n < 3, 0.0).otherwise(F.abs(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)) / 2)


def polygon_area(paths: Column) -> Column:
    return F.aggregate(F.transform(paths, ring_area), F.lit(0.0), lambda a, x: a + x)


def opening_area(width: Column, height: Column) -> Column:
    """Width by height where both lie in (0.1, 10) metres."""
    return F.when((width > 0.1) & (width < 10) & (height > 0.1) & (height < 10), width * height)


def opening_deduction(area: Column, count: Column) -> Column:
    return F.greatest(area - 2, F.lit(0.0)) * count
