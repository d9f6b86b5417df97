"""Geometry structs: types, parts and points, measures, predicates, codecs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.model import GEOMETRY
from . import bbox, srs

# Codes of shape types, and their modifier bits.
TYPES = {
    "null": 0, "point": 1, "point_m": 21, "point_zm": 11, "point_z": 9, "multipoint": 8, "multipoint_m": 28, "multipoint_zm": 18, "multipoint_z": 20, "polyline": 3, "polyline_m": 23,
    "polyline_zm": 13, "polyline_z": 10, "polygon": 5, "polygon_m": 25, "polygon_zm": 15, "polygon_z": 19, "multipatch_m": 31, "multipatch": 32,
    "general_polyline": 50, "general_polygon": 51, "general_point": 52, "general_multipoint": 53, "general_multipatch": 54,
}
HAS_Z, HAS_M, HAS_CURVES, HAS_IDS, BASIC_MASK = 0x80000000, 0x40000000, 0x20000000, 0x10000000, 0xFF
GENERAL = {"point": 52, "multipoint": 53, "polyline": 50, "polygon": 51, "multipatch": 54, "null": 0}
PATCH_TYPES = ["triangle_strip", "triangle_fan", "outer_ring", "inner_ring", "first_ring", "ring", "triangles"]


def _family(name: str) -> str:
    return name.removeprefix("general_").split("_")[0]


def _lookup(code: Column, pairs: dict[int, object], default: object) -> Column:
    entries = [F.lit(x) for kv in pairs.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*entries), code.cast("long").bitwiseAND(F.lit(BASIC_MASK)).cast("int")), F.lit(default))


def general_type(code: Column) -> Column:
    """The general type that a type belongs to, whatever its Z and M."""
    return _lookup(code, {c: GENERAL[_family(n)] for n, c in TYPES.items()}, 0)


def is_simple(code: Column) -> Column:
    """Whether a type's code says everything about it, rather than modifier bits."""
    return ~_lookup(code, {c: n.startswith("general") for n, c in TYPES.items()}, False)


def has_z(code: Column) -> Column:
    return _lookup(code, {c: "_z" in n for n, c in TYPES.items()}, False) | (~is_simple(code) & _bit(code, HAS_Z))


def has_m(code: Column) -> Column:
    return _lookup(code, {c: n.endswith("m") and "_" in n and not n.startswith("general") for n, c in TYPES.items()}, False) | (~is_simple(code) & _bit(code, HAS_M))


def has_curves(code: Column) -> Column:
    return ~is_simple(code) & _bit(code, HAS_CURVES)


def has_ids(code: Column) -> Column:
    return ~is_simple(code) & _bit(code, HAS_IDS)


def _bit(code: Column, bit: int) -> Column:
    return code.cast("long").bitwiseAND(F.lit(bit).cast("long")) != 0


# Points and parts. A geometry without part starts has one part if it has points.


def point_count(g: Column) -> Column:
    return F.coalesce(F.size(g["points"]), F.lit(0))


def part_count(g: Column) -> Column:
    starts = F.coalesce(F.size(g["parts"]), F.lit(0))
    return F.when(starts > 0, starts).otherwise(F.least(point_count(g), F.lit(1)))


def _starts(g: Column) -> Column:
    return F.when(F.coalesce(F.size(g["parts"]), F.lit(0)) > 0, g["parts"]).otherwise(F.array(F.lit(0)))


def part_sizes(starts: Column, total: Column) -> Column:
    """Points of each part: the next part's start, or the total, less its own."""
    return F.transform(starts, lambda s, i: F.coalesce(F.get(starts, i + 1), total.cast("int")) - s)


def part_points(g: Column, i: Column | int) -> Column:
    """The points of part i."""
    i = i if isinstance(i, Column) else F.lit(i)
    return F.slice(g["points"], F.get(_starts(g), i) + 1, F.get(part_sizes(_starts(g), point_count(g)), i))


def parts(g: Column) -> Column:
    """All parts as arrays of points."""
    starts, total = _starts(g), point_count(g)
    return F.transform(starts, lambda s, i: F.slice(g["points"], s + 1, F.coalesce(F.get(starts, i + 1), total) - s))


def point(g: Column, i: Column | int) -> Column:
    return F.get(g["points"], i if isinstance(i, Column) else F.lit(i))


def xs(g: Column) -> Column:
    return F.transform(g["points"], lambda p: p["x"])


def ys(g: Column) -> Column:
    return F.transform(g["points"], lambda p: p["y"])


def box_of(points: Column, zs: Column | None = None, ms: Column | None = None) -> Column:
    """The box of an array of points; the null box if there are none."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    span = lambda a: (F.coalesce(F.array_min(a), F.lit(0.0)), F.coalesce(F.array_max(a), F.lit(0.0))) if a is not None else (F.lit(0.0), F.lit(0.0))
    tag = F.when(F.coalesce(F.size(points), F.lit(0)) > 0, bbox.NORMAL).otherwise(bbox.NULL)
    return bbox.make(*span(x), *span(y), *span(zs), *span(ms), tag=tag)


def make(code: Column | int, points: Column, starts: Column | None = None, zs: Column | None = None, ms: Column | None = None, part_types: Column | None = None) -> Column:
    """A geometry, its box computed. A point's box is the point."""
    code = code if isinstance(code, Column) else F.lit(code)
    none = lambda c, kind: (F.lit(None) if c is None else c).cast(kind)
    return F.struct(
        code.cast("int").alias("type"), box_of(points, zs, ms).alias("bbox"), (F.array() if starts is None else starts).cast("array<int>").alias("parts"), none(part_types, "array<int>").alias("part_types"),
        points.cast("array<struct<x:double,y:double>>").alias("points"), none(zs, "array<double>").alias("zs"), none(ms, "array<double>").alias("ms"),
    )


def append(a: Column, b: Column) -> Column:
    """a with b's parts after its own."""
    moved = F.concat(_starts(a), F.transform(_starts(b), lambda s: s + point_count(a)))
    both = lambda n: F.when(a[n].isNull() | b[n].isNull(), F.lit(None)).otherwise(F.concat(a[n], b[n]))
    return make(a["type"], F.concat(a["points"], b["points"]), moved, both("zs"), both("ms"), both("part_types"))


def set_null(g: Column) -> Column:
    return make(TYPES["null"], F.slice(g["points"], 1, 0))


def is_valid(g: Column) -> Column:
    """Part starts ascend from 0 within the points, and Z and M are as many as the points."""
    starts, n = g["parts"], point_count(g)
    ascending = F.forall(F.transform(starts, lambda s, i: (s >= F.coalesce(F.get(starts, i - 1), F.lit(0))) & (s < n)), lambda ok: ok) & (F.coalesce(F.get(starts, F.lit(0)), F.lit(0)) == 0)
    return F.coalesce(ascending, F.lit(True)) & (g["zs"].isNull() | (F.size(g["zs"]) == n)) & (g["ms"].isNull() | (F.size(g["ms"]) == n))


def equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


# Measures and predicates over arrays of points.


def _pairs(points: Column) -> Column:
    n = F.size(points)
    return F.arrays_zip(F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def turn(points: Column) -> Column:
    """Sum of (y2 + y1)(x2 - x1) along the points: twice the signed area, positive clockwise, of a closed ring."""
    return _sum(F.transform(_pairs(points), lambda p: (p["b"]["y"] + p["a"]["y"]) * (p["b"]["x"] - p["a"]["x"])))


def is_clockwise(points: Column) -> Column:
    return turn(points) >= 0


def length(points: Column) -> Column:
    return _sum(F.transform(_pairs(points), lambda p: F.hypot(p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"])))


def perimeter(points: Column) -> Column:
    return length(_closed(points))


def _closed(points: Column) -> Column:
    return F.when(F.get(points, F.lit(0)) == F.element_at(points, -1), points).otherwise(F.concat(points, F.slice(points, 1, 1)))


def area(points: Column) -> Column:
    return F.abs(turn(_closed(points))) / 2


def shape_area(g: Column) -> Column:
    """The area of a polygon's rings, counterclockwise ones taken off."""
    return F.abs(_sum(F.transform(parts(g), lambda p: turn(_closed(p)) / 2)))


def shape_length(g: Column) -> Column:
    return _sum(F.transform(parts(g), length))


def centroid(points: Column) -> Column:
    """The mean of the points."""
    n = F.size(points)
    return F.struct((_sum(F.transform(points, lambda p: p["x"])) / n).alias("x"), (_sum(F.transform(points, lambda p: p["y"])) / n).alias("y"))


def point_in_ring(points: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside a ring by the number of edges that a ray to the right crosses; points on the border may go either way."""
    crosses = F.filter(_pairs(_closed(points)), lambda p: ((p["a"]["y"] > y) != (p["b"]["y"] > y)) & (x < (p["b"]["x"] - p["a"]["x"]) * (y - p["a"]["y"]) / (p["b"]["y"] - p["a"]["y"]) + p["a"]["x"]))
    return F.size(crosses) % 2 == 1


def point_on_border(points: Column, x: Column, y: Column, eps: float = 1e-9) -> Column:
    return F.exists(_pairs(_closed(points)), lambda p: segment_distance(p["a"], p["b"], x, y) <= eps)


def segment_distance(a: Column, b: Column, x: Column, y: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a["x"]) * dx + (y - a["y"]) * dy) / square)))
    return F.hypot(x - a["x"] - t * dx, y - a["y"] - t * dy)


def distance_to_point(points: Column, x: Column, y: Column) -> Column:
    return F.array_min(F.transform(_pairs(points), lambda p: segment_distance(p["a"], p["b"], x, y)))


def cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def segments_meet(a: Column, b: Column, c: Column, d: Column, eps: float = 1e-30) -> Column:
    """The point where segments ab and cd cross, or NULL; parallel ones don't."""
    rx, ry, sx, sy = b["x"] - a["x"], b["y"] - a["y"], d["x"] - c["x"], d["y"] - c["y"]
    k = cross(rx, ry, sx, sy)
    safe = F.when(F.abs(k) > eps, k)
    t, u = cross(c["x"] - a["x"], c["y"] - a["y"], sx, sy) / safe, cross(c["x"] - a["x"], c["y"] - a["y"], rx, ry) / safe
    return F.when(t.between(0, 1) & u.between(0, 1), F.struct((a["x"] + t * rx).alias("x"), (a["y"] + t * ry).alias("y")))


def near(a: Column, b: Column, eps: float = 1e-5) -> Column:
    return F.abs(a - b) <= eps


def rotate(points: Column, cx: float, cy: float, degrees: float) -> Column:
    """Points turned counterclockwise about a center."""
    import math

    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return F.transform(points, lambda p: F.struct(((p["x"] - cx) * c - (p["y"] - cy) * s + cx).alias("x"), ((p["x"] - cx) * s + (p["y"] - cy) * c + cy).alias("y")))


def drop_repeats(points: Column) -> Column:
    """Without points equal to their predecessor."""
    return F.filter(points, lambda p, i: (i == 0) | (F.get(points, i - 1) != p))


#: Fewest points that a drawn shape may be left with.
FEWEST = {"point": 0, "polyline": 2, "polygon": 4}


def thin(g: Column, tolerance: float) -> Column:
    """A geometry without the points of a part that lie within tolerance of the last kept one; ends stay. Z and M go with their points."""
    zero = lambda c: F.when(c.isNull(), F.array_repeat(F.lit(0.0), F.size(g["points"]))).otherwise(c)
    rows = F.arrays_zip(g["points"].alias("p"), zero(g["zs"]).alias("z"), zero(g["ms"]).alias("m"))
    starts, total = _starts(g), point_count(g)

    def part(s: Column, i: Column) -> Column:
        own = F.slice(rows, s + 1, F.coalesce(F.get(starts, i + 1), total) - s)
        far = lambda a, x: F.hypot(F.element_at(a, -1)["p"]["x"] - x["p"]["x"], F.element_at(a, -1)["p"]["y"] - x["p"]["y"]) > tolerance
        inner = F.aggregate(F.slice(own, F.lit(2), F.greatest(F.size(own) - 2, F.lit(0))), F.slice(own, 1, 1), lambda a, x: F.when(far(a, x), F.concat(a, F.array(x))).otherwise(a))
        return F.when(F.size(own) < 2, own).otherwise(F.concat(inner, F.slice(own, -1, 1)))

    kept = F.transform(starts, part)

    def rebuilt(k: Column) -> Column:
        flat = F.flatten(k)
        at = F.transform(k, lambda _, i: F.aggregate(F.slice(k, F.lit(1), i), F.lit(0), lambda a, x: a + F.size(x)))
        back = lambda n, f: F.when(g[n].isNotNull(), F.transform(flat, lambda r: r[f]))
        new = make(g["type"], F.transform(flat, lambda r: r["p"]), F.when(F.size(g["parts"]) > 0, at).otherwise(g["parts"]), back("zs", "z"), back("ms", "m"), g["part_types"])
        return new

    return F.when(point_count(g) > 0, F.transform(F.array(kept), rebuilt)[0]).otherwise(g)


def transform(g: Column, source: str, target: str) -> Column:
    """A geometry in another reference system. Points that it can't show are dropped, and a geometry that loses all is the null one."""
    moved = srs.transformer(source, target)
    shown = F.transform(g["points"], lambda p: moved(p["x"], p["y"]))
    kept = F.filter(shown, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    whole = F.size(kept) == F.size(shown)

    def rebuilt(k: Column) -> Column:
        lost = F.transform(shown, lambda p: (p["x"].isNull() | p["y"].isNull()).cast("int"))
        at = F.transform(g["parts"], lambda s: s - F.aggregate(F.slice(lost, F.lit(1), s), F.lit(0), lambda a, x: a + x))
        some = lambda n: F.when(whole, g[n]).otherwise(F.filter(g[n], lambda _, i: F.get(lost, i) == 0))
        return make(F.when(F.size(k) > 0, g["type"]).otherwise(TYPES["null"]), k, F.when(F.size(k) > 0, at).otherwise(F.array().cast("array<int>")), some("zs"), some("ms"), g["part_types"])

    return F.when(g.isNotNull(), F.transform(F.array(kept), rebuilt)[0])


# Binary form: flag, type, box of 8 doubles, parts, points, and Z and M where there are any.


def blob_size(code_has_z: bool, code_has_m: bool, points: Column, part_total: Column) -> Column:
    return F.lit(1 + 4 + 4 + 64 + 8) + 4 * part_total + (16 + 8 * code_has_z + 8 * code_has_m) * points


_HEAD = np.dtype([("flag", "u1"), ("type", "<u4"), ("tag", "<i4"), ("box", "<f8", 8), ("parts", "<i4"), ("points", "<i4")])
_NAMES = [f"{r}{e}" for r in "xyzm" for e in ("Min", "Max")]


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places from each start on, sizes of them, all in a row."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _numbers(a: pa.Array, empty: float = 0) -> np.ndarray:
    return pc.fill_null(a, empty).to_numpy(zero_copy_only=False)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of a list column: which rows have one, its sizes (0 where not), and the values in a row."""
    there = pc.is_valid(lists).to_numpy(zero_copy_only=False)
    return there, _numbers(pc.list_value_length(lists)).astype(np.int64), lists.flatten()


def encode_shapes(g: pa.Array) -> pa.Array:
    """The binary forms of a column of geometries; whole columns at a time, in numpy."""
    field = lambda name: pc.struct_field(g, name)
    n, valid = len(g), pc.and_(pc.is_valid(g), pc.is_valid(field("type"))).to_numpy(zero_copy_only=False)
    box = field("bbox")
    _, n_parts, starts = _flat(field("parts"))
    has_kinds, _, kinds = _flat(field("part_types"))
    _, n_points, points = _flat(field("points"))
    has_z, n_z, zs = _flat(field("zs"))
    has_m, n_m, ms = _flat(field("ms"))
    head = np.zeros(n, _HEAD)
    head["flag"] = has_z * 1 | has_m * 2 | has_kinds * 4
    head["type"] = _numbers(field("type")).astype(np.int64) & 0xFFFFFFFF
    head["tag"] = _numbers(pc.struct_field(box, "type"))
    for k, name in enumerate(_NAMES):
        head["box"][:, k] = _numbers(pc.struct_field(box, name))
    head["parts"], head["points"] = n_parts, n_points
    xy = np.stack([_numbers(pc.struct_field(points, c)) for c in "xy"], 1) if len(points) else np.zeros((0, 2))
    bodies = [
        (np.full(n, _HEAD.itemsize), head.view(np.uint8).reshape(-1)), (4 * n_parts, _numbers(starts).astype("<i4").view(np.uint8)), (np.where(has_kinds, 4 * n_parts, 0), _numbers(kinds).astype("<i4").view(np.uint8)),
        (16 * n_points, np.ascontiguousarray(xy, "<f8").view(np.uint8).reshape(-1)), (8 * n_z, _numbers(zs, np.nan).astype("<f8").view(np.uint8)), (8 * n_m, _numbers(ms, np.nan).astype("<f8").view(np.uint8)),
    ]
    sizes = sum(size for size, _ in bodies)
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    out, at = np.empty(int(offsets[-1]), np.uint8), offsets[:-1].copy()
    for size, data in bodies:
        out[_places(at, size)] = data
        at += size
    made = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])
    return made if valid.all() else pc.if_else(pa.array(valid), made, pa.scalar(None, pa.binary()))


def decode_shapes(blobs: pa.Array) -> pa.Array:
    """A column of geometries of their binary forms."""
    valid = pc.is_valid(blobs).to_numpy(zero_copy_only=False)
    n = len(blobs)
    joined = np.frombuffer(b"".join(b for b in blobs.to_pylist() if b is not None), np.uint8)
    sizes = _numbers(pc.binary_length(blobs)).astype(np.int64)
    at = np.cumsum(sizes) - sizes
    head = np.zeros(n, _HEAD)
    head.view(np.uint8).reshape(n, -1)[valid] = joined[_places(at[valid], np.full(valid.sum(), _HEAD.itemsize))].reshape(-1, _HEAD.itemsize)
    place = at + _HEAD.itemsize

    def take(counts: np.ndarray, kind: str, there: np.ndarray, width: int = 1) -> pa.Array:
        nonlocal place
        size = np.dtype(kind).itemsize * width
        counts = np.where(there, counts, 0)
        values = joined[_places(place, counts * size)].view(kind)
        place = place + counts * size
        offsets = np.zeros(n + 1, np.int32)
        np.cumsum(counts, out=offsets[1:])
        if width == 2:
            values = pa.StructArray.from_arrays([pa.array(values[0::2]), pa.array(values[1::2])], ["x", "y"])
        else:
            values = pa.array(values, mask=np.isnan(values)) if kind == "<f8" else pa.array(values)
        return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(~there))

    n_parts, n_points, flag = head["parts"].astype(np.int64), head["points"].astype(np.int64), head["flag"]
    starts, kinds = take(n_parts, "<i4", valid), take(n_parts, "<i4", valid & (flag & 4 > 0))
    points = take(n_points, "<f8", valid, 2)
    zs, ms = (take(n_points, "<f8", valid & (flag & bit > 0)) for bit in (1, 2))
    box = pa.StructArray.from_arrays([pa.array(head["tag"]), *[pa.array(np.ascontiguousarray(head["box"][:, k])) for k in range(8)]], ["type", *_NAMES])
    columns = [pa.array(head["type"].astype(np.int64).astype(np.int32)), box, starts, kinds, points, zs, ms]
    return pa.StructArray.from_arrays(columns, ["type", "bbox", "parts", "part_types", "points", "zs", "ms"], mask=pa.array(~valid))


@F.arrow_udf(T.BinaryType())
def to_blob(g: pa.Array) -> pa.Array:
    return encode_shapes(g)


@F.arrow_udf(GEOMETRY)
def from_blob(b: pa.Array) -> pa.Array:
    return decode_shapes(b)


Shape = Callable[[Column], Column]
