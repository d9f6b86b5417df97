"""Bounding-box algebra on structs of a tag and ranges, and on flat rectangles."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A box's tags. A null box has no extent and is unlike SQL's NULL.
INVALID, NULL, INFINITE, NORMAL = -1, 0, 1, 2
RANGES = ("x", "y", "z", "m")


def make(xmin, xmax, ymin, ymax, zmin=0.0, zmax=0.0, mmin=0.0, mmax=0.0, tag=NORMAL) -> Column:  # noqa: ANN001
    """A box of columns or numbers."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    names = ("xMin", "xMax", "yMin", "yMax", "zMin", "zMax", "mMin", "mMax")
    return F.struct(as_column(tag).cast("int").alias("type"), *[as_column(v).cast("double").alias(n) for n, v in zip(names, (xmin, xmax, ymin, ymax, zmin, zmax, mmin, mmax))])


def _used(use_z: bool, use_m: bool) -> tuple[str, ...]:
    return RANGES[: 2 + use_z] + (("m",) if use_m else ())


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def equal(a: Column, b: Column) -> Column:
    """Null boxes are equal, so are infinite ones, and normal ones with equal ranges; an invalid box equals nothing."""
    same = _all([(a[f"{r}{e}"] == b[f"{r}{e}"]) for r in RANGES for e in ("Min", "Max")])
    return F.when((a["type"] == INVALID) | (a["type"] != b["type"]), False).when(a["type"].isin(NULL, INFINITE), True).otherwise(same)


def not_equal(a: Column, b: Column) -> Column:
    return ~equal(a, b)


def order_key(a: Column) -> Column:
    """What boxes are sorted by: xMin, yMin, xMax, yMax."""
    return F.struct(a["xMin"], a["yMin"], a["xMax"], a["yMax"])


def less(a: Column, b: Column) -> Column:
    return order_key(a) < order_key(b)


def contains(a: Column, b: Column, use_z: bool = False, use_m: bool = False) -> Column:
    """Whether a contains b, borders included. Any valid box contains the null one, and an infinite one any valid one."""
    inside = _all([(a[f"{r}Min"] <= b[f"{r}Min"]) & (b[f"{r}Max"] <= a[f"{r}Max"]) for r in _used(use_z, use_m)])
    return F.when((a["type"] == INVALID) | (b["type"] == INVALID), False).when(b["type"] == NULL, True).when(a["type"] == NULL, False).when(a["type"] == INFINITE, True).when(b["type"] == INFINITE, False).otherwise(inside)


def intersects(a: Column, b: Column, use_z: bool = False, use_m: bool = False) -> Column:
    """Whether closed boxes meet. Nothing meets an invalid or null box; an infinite one meets all others."""
    meet = _all([(a[f"{r}Max"] >= b[f"{r}Min"]) & (a[f"{r}Min"] <= b[f"{r}Max"]) for r in _used(use_z, use_m)])
    return F.when(a["type"].isin(INVALID, NULL) | b["type"].isin(INVALID, NULL), False).when((a["type"] == INFINITE) | (b["type"] == INFINITE), True).otherwise(meet)


def expand(a: Column, b: Column) -> Column:
    """The least box around both. Null and invalid boxes add nothing; an infinite one takes all."""
    both = make(*[f(a[n], b[n]) for n, f in (("xMin", F.least), ("xMax", F.greatest), ("yMin", F.least), ("yMax", F.greatest), ("zMin", F.least), ("zMax", F.greatest), ("mMin", F.least), ("mMax", F.greatest))])
    absent = lambda x: x["type"].isin(INVALID, NULL)
    return F.when(absent(b), a).when(absent(a), b).when(a["type"] == INFINITE, a).when(b["type"] == INFINITE, b).otherwise(both)


def extent(df: DataFrame, by: tuple[str, ...] = (), names: tuple[str, str, str, str] = ("xmin", "ymin", "xmax", "ymax")) -> DataFrame:
    """The extent of a table's flat boxes, by group if wanted: one row of minima and maxima."""
    x0, y0, x1, y1 = names
    return df.groupBy(*by).agg(F.min(x0).alias("xmin"), F.min(y0).alias("ymin"), F.max(x1).alias("xmax"), F.max(y1).alias("ymax"))


# Plain rectangles (xmin, ymin, xmax, ymax) on the driver and as columns of a struct with these names.


def envelope_intersect(a: tuple[float, ...], b: tuple[float, ...] | None) -> tuple[float, ...] | None:
    """The part that two extents share, touching counted; without another, the extent itself. None if they share nothing."""
    found = a if b is None else (max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3]))
    return found if found[0] <= found[2] and found[1] <= found[3] else None


def envelope_expand(a: tuple[float, ...] | None, b: tuple[float, ...] | None) -> tuple[float, ...] | None:
    if a is None or b is None:
        return a if b is None else b
    return (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))


def rect(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.struct(xmin.alias("xmin"), ymin.alias("ymin"), xmax.alias("xmax"), ymax.alias("ymax"))


def rect_meets(a: Column, b: Column) -> Column:
    """Open intersection, as of device rectangles: touching ones don't meet."""
    return (a["xmin"] < b["xmax"]) & (b["xmin"] < a["xmax"]) & (a["ymin"] < b["ymax"]) & (b["ymin"] < a["ymax"])


def rect_holds_point(a: Column, x: Column, y: Column, closed: bool = False) -> Column:
    if closed:
        return x.between(a["xmin"], a["xmax"]) & y.between(a["ymin"], a["ymax"])
    return (x > a["xmin"]) & (x < a["xmax"]) & (y > a["ymin"]) & (y < a["ymax"])


def rect_inside(a: Column, b: Column) -> Column:
    """Whether a lies in b."""
    return (a["xmin"] >= b["xmin"]) & (a["xmax"] <= b["xmax"]) & (a["ymin"] >= b["ymin"]) & (a["ymax"] <= b["ymax"])


def rect_expand(a: Column, b: Column) -> Column:
    return rect(F.least(a["xmin"], b["xmin"]), F.least(a["ymin"], b["ymin"]), F.greatest(a["xmax"], b["xmax"]), F.greatest(a["ymax"], b["ymax"]))


def rect_intersect(a: Column, b: Column) -> Column:
    """The shared rectangle, or NULL where they don't meet."""
    return F.when(rect_meets(a, b), rect(F.greatest(a["xmin"], b["xmin"]), F.greatest(a["ymin"], b["ymin"]), F.least(a["xmax"], b["xmax"]), F.least(a["ymax"], b["ymax"])))


def rect_inflate(a: Column, dx: Column | float, dy: Column | float) -> Column:
    return rect(a["xmin"] - dx, a["ymin"] - dy, a["xmax"] + dx, a["ymax"] + dy)


def rect_offset(a: Column, dx: Column | float, dy: Column | float) -> Column:
    return rect(a["xmin"] + dx, a["ymin"] + dy, a["xmax"] + dx, a["ymax"] + dy)


def rect_center(a: Column) -> Column:
    return F.struct(((a["xmin"] + a["xmax"]) / 2).alias("x"), ((a["ymin"] + a["ymax"]) / 2).alias("y"))


def rect_scale(a: Column, factor: float) -> Column:
    """Scaled about its center."""
    dx, dy = ((a[f"{r}max"] - a[f"{r}min"]) * (factor - 1) / 2 for r in "xy")
    return rect_inflate(a, dx, dy)


def rect_empty(a: Column) -> Column:
    return (a["xmax"] <= a["xmin"]) | (a["ymax"] <= a["ymin"])


def symbol_margin(box: tuple[float, float, float, float], width_px: float, units_per_px: float) -> tuple[float, float, float, float]:
    """A view box widened by a symbol's width in map units, two pixels at least."""
    d = max(2.0, math.ceil(width_px)) * units_per_px
    return (box[0] - d, box[1] - d, box[2] + d, box[3] + d)
