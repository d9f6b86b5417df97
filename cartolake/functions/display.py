"""Map to device transformation, clipping and what goes with them."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import INCHES_PER_METER, length_factor

# Bits of a point's place against a rectangle, and inches of a millimetre.
LEFT, RIGHT, TOP, BOTTOM = 1, 2, 4, 8
INCHES_PER_MM = 0.03937


@dataclass(frozen=True)
class View:
    """A map seen on a device of width x height pixels at resolution dpi: the map point at its center, scale 1:n and rotation in degrees.

    The device's y axis goes down unless flip_y.
    """

    width: int
    height: int
    x: float
    y: float
    scale: float
    resolution: float = 96.0
    units: str = "meters"
    angle: float = 0.0
    flip_x: bool = False
    flip_y: bool = False

    @property
    def units_per_inch(self) -> float:
        if self.units == "decimal_degrees":
            return 1 / INCHES_PER_METER / 111194.8742964
        return length_factor("inches", "centimeters" if self.units == "unknown" else self.units)

    @property
    def ratio(self) -> float:
        """Map units of a pixel."""
        return self.scale * self.units_per_inch / self.resolution

    @property
    def matrix(self) -> tuple[float, float, float, float]:
        """m00, m01, m10, m11 from map to device: turned, then scaled and flipped."""
        s = 1 / self.ratio if self.ratio else 1.0
        sx, sy = (-s if self.flip_x else s), (s if self.flip_y else -s)
        c, n = math.cos(math.radians(self.angle)), math.sin(math.radians(self.angle))
        return c * sx, -n * sx, n * sy, c * sy

    @property
    def anchor(self) -> tuple[int, int]:
        return self.width // 2, self.height // 2

    def fit(self, box: tuple[float, float, float, float]) -> View:
        """The view of a whole box: centered on it, at the least scale that shows it."""
        from dataclasses import replace

        per = max((box[2] - box[0]) / self.width, (box[3] - box[1]) / self.height) or 1.0
        return replace(self, x=(box[0] + box[2]) / 2, y=(box[1] + box[3]) / 2, scale=per * self.resolution / self.units_per_inch)

    def moved(self, x: float, y: float) -> View:
        from dataclasses import replace

        return replace(self, x=x, y=y)

    def extent(self) -> tuple[float, float, float, float]:
        """The map box that the device shows."""
        corners = [self._back(px, py) for px in (0, self.width) for py in (0, self.height)]
        return min(c[0] for c in corners), min(c[1] for c in corners), max(c[0] for c in corners), max(c[1] for c in corners)

    def _back(self, px: float, py: float) -> tuple[float, float]:
        a, b, c, d = self.matrix
        det = a * d - b * c
        dx, dy = px - self.anchor[0], py - self.anchor[1]
        return (d * dx - b * dy) / det + self.x, (a * dy - c * dx) / det + self.y


def to_device(view: View, x: Column, y: Column) -> tuple[Column, Column]:
    """Device pixels of map points, halves rounded up."""
    a, b, c, d = view.matrix
    dx, dy = x - F.lit(view.x), y - F.lit(view.y)
    px = F.floor(dx * a + dy * b + 0.5) + view.anchor[0]
    py = F.floor(dx * c + dy * d + 0.5) + view.anchor[1]
    return px, py


def to_device_clamped(view: View, x: Column, y: Column, bound: int = 32767) -> tuple[Column, Column]:
    return tuple(F.greatest(F.lit(-bound), F.least(F.lit(bound), v)) for v in to_device(view, x, y))  # type: ignore[return-value]


def to_map(view: View, px: Column, py: Column) -> tuple[Column, Column]:
    a, b, c, d = view.matrix
    det = a * d - b * c
    dx, dy = px - view.anchor[0], py - view.anchor[1]
    return (dx * (d / det) - dy * (b / det)) + view.x, (dy * (a / det) - dx * (c / det)) + view.y


def box_to_device(view: View, x0: Column, y0: Column, x1: Column, y1: Column) -> list[Column]:
    """The device box of a map box's corners: xmin, ymin, xmax, ymax."""
    corners = [to_device(view, x, y) for x in (x0, x1) for y in (y0, y1)]
    return [f(*[c[k] for c in corners]) for f, k in ((F.least, 0), (F.least, 1), (F.greatest, 0), (F.greatest, 1))]


def box_to_map(view: View, x0: Column, y0: Column, x1: Column, y1: Column) -> list[Column]:
    corners = [to_map(view, x, y) for x in (x0, x1) for y in (y0, y1)]
    return [f(*[c[k] for c in corners]) for f, k in ((F.least, 0), (F.least, 1), (F.greatest, 0), (F.greatest, 1))]


def length_to_device(view: View, length: Column) -> Column:
    return length / view.ratio


def length_to_map(view: View, pixels: Column) -> Column:
    return pixels * view.ratio


def mm_to_pixels(mm: Column, resolution: float = 96.0) -> Column:
    return mm * INCHES_PER_MM * resolution


def pixels_to_mm(px: Column, resolution: float = 96.0) -> Column:
    return px / INCHES_PER_MM / resolution


def region_code(x: Column, y: Column, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """Bits of the sides of a rectangle that a point is beyond; 0 inside and on the border."""
    bit = lambda condition, value: F.when(condition, value).otherwise(0)
    return bit(x < xmin, LEFT) + bit(x > xmax, RIGHT) + bit(y < ymin, BOTTOM) + bit(y > ymax, TOP)


def all_inside(points: Column, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    return F.forall(points, lambda p: region_code(p["x"], p["y"], xmin, ymin, xmax, ymax) == 0)


def all_outside(points: Column, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """Whether all points are beyond one same side, so that nothing can be seen."""
    codes = F.transform(points, lambda p: region_code(p["x"], p["y"], xmin, ymin, xmax, ymax))
    return F.aggregate(codes, F.lit(LEFT | RIGHT | TOP | BOTTOM), lambda a, c: a.bitwiseAND(c)) != 0


def scale_visible(scale: float | Column, least: float | Column, most: float | Column) -> Column:
    """Whether a layer of scales 1:most to 1:least shows at a scale; 0 is no bound."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    s, low, high = map(as_column, (scale, most, least))
    return ((low == 0) | (s >= low)) & ((high == 0) | (s <= high))


# Clipping, of single shapes in numpy, points being arrays of shape (n, 2), and of columns; boxes are (xmin, ymin, xmax, ymax).

Box = tuple[float, float, float, float]


def clip_segment(a: np.ndarray, b: np.ndarray, box: Box) -> tuple[np.ndarray, np.ndarray] | None:
    """The part of a segment inside a box, by its end points' codes."""

    def code(p: np.ndarray) -> int:
        return (p[0] < box[0]) * LEFT | (p[0] > box[2]) * RIGHT | (p[1] < box[1]) * BOTTOM | (p[1] > box[3]) * TOP

    a, b = np.asarray(a, float), np.asarray(b, float)
    ca, cb = code(a), code(b)
    while ca | cb:
        if ca & cb:
            return None
        c = ca or cb
        d = b - a
        if c & (TOP | BOTTOM):
            y = box[3] if c & TOP else box[1]
            p = np.array([a[0] + d[0] * (y - a[1]) / d[1], y])
        else:
            x = box[2] if c & RIGHT else box[0]
            p = np.array([x, a[1] + d[1] * (x - a[0]) / d[0]])
        if c == ca:
            a, ca = p, code(p)
        else:
            b, cb = p, code(p)
    return a, b


def clip_line(points: np.ndarray, box: Box) -> list[np.ndarray]:
    """The runs of a polyline inside a box; it is split where it leaves it."""
    out: list[list[np.ndarray]] = []
    for a, b in zip(points[:-1], points[1:]):
        found = clip_segment(a, b, box)
        if found is None:
            continue
        if out and (out[-1][-1] == found[0]).all() and (found[0] == a).all():
            out[-1].append(found[1])
        else:
            out.append([found[0], found[1]])
    return [np.array(run) for run in out]


def clip_ring(points: np.ndarray, box: Box) -> np.ndarray:
    """A ring inside a box, side by side: left, top, right, bottom. It is closed again and keeps its orientation."""
    ring = points[:-1] if len(points) > 1 and (points[0] == points[-1]).all() else points
    for axis, bound, sign in ((0, box[0], 1), (1, box[3], -1), (0, box[2], -1), (1, box[1], 1)):
        if not len(ring):
            break
        inside = sign * (ring[:, axis] - bound) >= 0
        out = []
        for i in range(len(ring)):
            j = i - 1
            if inside[i] != inside[j]:
                t = (bound - ring[j, axis]) / (ring[i, axis] - ring[j, axis])
                p = ring[j] + t * (ring[i] - ring[j])
                p[axis] = bound
                out.append(p)
            if inside[i]:
                out.append(ring[i])
        ring = np.array(out).reshape(-1, 2)
    return np.concatenate([ring, ring[:1]]) if len(ring) else ring


_RUNS = "array<array<struct<x:double,y:double>>>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), use)[0]


def segment_inside(a: Column, b: Column, box: Box) -> Column:
    """The parametric range of a segment that lies in a box, as from and to, after Liang and Barsky; NULL if none does."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    sides = [(-dx, a["x"] - box[0]), (dx, box[2] - a["x"]), (-dy, a["y"] - box[1]), (dy, box[3] - a["y"])]
    low = F.greatest(F.lit(0.0), *[F.when(p < 0, q / p) for p, q in sides])
    high = F.least(F.lit(1.0), *[F.when(p > 0, q / p) for p, q in sides])
    beyond = (dx == 0) & ((a["x"] < box[0]) | (a["x"] > box[2])) | (dy == 0) & ((a["y"] < box[1]) | (a["y"] > box[3]))
    return F.when(~beyond & (low <= high), F.struct(low.alias("from"), high.alias("to")))


def clip_lines(parts: Column, box: Box) -> Column:
    """Polylines' parts inside a box: runs of points; a line is split where it leaves the box."""
    at = lambda s, t: F.struct((s["a"]["x"] + t * (s["b"]["x"] - s["a"]["x"])).alias("x"), (s["a"]["y"] + t * (s["b"]["y"] - s["a"]["y"])).alias("y"))

    def runs(points: Column) -> Column:
        n = F.greatest(F.size(points) - 1, F.lit(0))
        pairs = F.arrays_zip(F.slice(points, F.lit(1), n).alias("a"), F.slice(points, F.lit(2), n).alias("b"))
        seen = F.filter(F.transform(pairs, lambda s, i: F.struct(i.alias("i"), s["a"].alias("a"), s["b"].alias("b"), segment_inside(s["a"], s["b"], box).alias("t"))), lambda s: s["t"].isNotNull())
        first = lambda s: F.when(s["t"]["from"] == 0, s["a"]).otherwise(at(s, s["t"]["from"]))
        last = lambda s: F.when(s["t"]["to"] == 1, s["b"]).otherwise(at(s, s["t"]["to"]))

        def joined(ss: Column) -> Column:
            begins = lambda s, k: (k == 0) | (s["t"]["from"] > 0) | (F.get(ss, k - 1)["i"] + 1 != s["i"]) | (F.get(ss, k - 1)["t"]["to"] < 1)
            heads = F.filter(F.transform(ss, lambda s, k: F.when(begins(s, k), k)), lambda k: k.isNotNull())
            return _once(heads, lambda hs: F.transform(hs, lambda h, j: F.concat(F.array(first(F.get(ss, h))), F.transform(F.slice(ss, h + 1, F.coalesce(F.get(hs, j + 1), F.size(ss)) - h), last))))

        return _once(seen, joined)

    empty = F.array().cast(_RUNS)
    return F.when(parts.isNotNull(), F.coalesce(F.flatten(F.transform(parts, runs)).cast(_RUNS), empty))


def clip_polygons(parts: Column, box: Box) -> Column:
    """Polygons' rings inside a box, side by side: left, top, right, bottom; closed again, orientation kept, empty ones gone."""

    def side(ring: Column, axis: str, bound: float, sign: int) -> Column:
        def cut(r: Column) -> Column:
            n = F.size(r)
            inside = lambda p: (p[axis] - bound) * sign >= 0

            def at(p: Column, i: Column) -> Column:
                before = F.get(r, (i + n - 1) % n)
                t = (bound - before[axis]) / (p[axis] - before[axis])
                along = lambda c: F.lit(float(bound)) if c == axis else before[c] + t * (p[c] - before[c])
                met = F.array(F.struct(along("x").alias("x"), along("y").alias("y")))
                none = F.array().cast("array<struct<x:double,y:double>>")
                return F.concat(F.when(inside(p) != inside(before), met).otherwise(none), F.when(inside(p), F.array(p)).otherwise(none))

            return F.when(n > 0, F.flatten(F.transform(r, at))).otherwise(r)

        return _once(ring, cut)

    def clipped(ring: Column) -> Column:
        out = F.when((F.size(ring) > 1) & (F.get(ring, F.lit(0)) == F.element_at(ring, -1)), F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)
        for axis, bound, sign in (("x", box[0], 1), ("y", box[3], -1), ("x", box[2], -1), ("y", box[1], 1)):
            out = side(out, axis, bound, sign)
        return _once(out, lambda r: F.concat(r, F.slice(r, 1, 1)))

    return F.filter(F.transform(parts.cast(_RUNS), clipped), lambda r: F.size(r) > 0)


def shape_to_device(view: View, parts: Column) -> Column:
    """Parts in device pixels, a point equal to its predecessor dropped."""

    def place(p: Column) -> Column:
        x, y = to_device(view, p["x"], p["y"])
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    moved = F.transform(parts, lambda part: F.transform(part, place))
    return F.transform(moved, lambda part: F.filter(part, lambda p, i: (i == 0) | (F.get(part, i - 1) != p)))


# 4 x 4 matrices, on the driver.


def rotation(degrees_x: float = 0, degrees_y: float = 0, degrees_z: float = 0) -> np.ndarray:
    """Turned about x, then y, then z."""
    out = np.eye(4)
    for axis, degrees in enumerate((degrees_x, degrees_y, degrees_z)):
        c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
        i, j = [k for k in range(3) if k != axis]
        m = np.eye(4)
        m[i, i] = m[j, j] = c
        m[i, j], m[j, i] = (-s, s) if axis != 1 else (s, -s)
        out = m @ out
    return out


def scaling(x: float, y: float, z: float = 1) -> np.ndarray:
    return np.diag([x, y, z, 1.0])


def translation(x: float, y: float, z: float = 0) -> np.ndarray:
    out = np.eye(4)
    out[:3, 3] = (x, y, z)
    return out


def apply(matrix: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Points of shape (n, 3) moved by a matrix."""
    moved = np.concatenate([points, np.ones((len(points), 1))], 1) @ matrix.T
    return moved[:, :3] / moved[:, 3:]


def inverse(matrix: np.ndarray) -> np.ndarray | None:
    """The inverse, or None of a matrix without one."""
    return None if abs(np.linalg.det(matrix)) < 1e-300 else np.linalg.inv(matrix)


def decomposed(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Translation, rotation and scale of an affine matrix that is made of these, applied scale first."""
    scale = np.linalg.norm(matrix[:3, :3], axis=0)
    if np.linalg.det(matrix[:3, :3]) < 0:
        scale = scale * (-1, 1, 1)
    return matrix[:3, 3].copy(), matrix[:3, :3] / scale, scale


#: What of a map is drawn, by bits: fixed values.
PHASES = {"geography": 1, "annotation": 2, "selection": 4, "graphics": 8}


def phases(mask: int) -> list[str]:
    """The phases of a mask, in the order that they are drawn."""
    return [name for name, bit in PHASES.items() if mask & bit]
