"""Topological relations and overlays of rings, as columns over arrays of points.

A ring is an array of points, closed or not. Relations take simple rings; overlays need a convex second ring and give rings, or arrays of rings
where the result may fall apart. Everything is expressions over arrays, in time of the product of the rings' points, so it belongs after a join of
boxes (operators.spatial_join.join_shapes). A NULL ring gives NULL.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry

_RING = "array<struct<x:double,y:double>>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), use)[0]


def _bound(f: Callable[..., Column]) -> Callable[..., Column]:
    """f over arguments that are computed once, however often f names them."""

    @functools.wraps(f)
    def call(*args: object, **named: object) -> Column:
        held = {i: a for i, a in enumerate(args) if isinstance(a, Column)}
        return _once(F.struct(*[a.alias(f"c{i}") for i, a in held.items()]), lambda s: f(*[s[f"c{i}"] if i in held else a for i, a in enumerate(args)], **named))

    return call


def _all(*conditions: Column) -> Column:
    return functools.reduce(lambda a, b: a & b, conditions)


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _turn(a: Column, b: Column, c: Column) -> Column:
    """Twice the signed area of a triangle, positive where c lies left of the way from a to b."""
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def open_ring(ring: Column) -> Column:
    """Without a last point that repeats the first."""
    return F.when((F.size(ring) > 1) & (F.get(ring, F.lit(0)) == F.element_at(ring, -1)), F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)


@_bound
def boundary(ring: Column) -> Column:
    """The closed line around a ring."""
    return F.when(F.size(ring) > 0, _once(open_ring(ring), lambda r: F.concat(r, F.slice(r, 1, 1)))).otherwise(ring)


def _edges(ring: Column) -> Column:
    """Edges of a ring as a, b, the closing one included."""
    return _once(open_ring(ring), lambda r: F.transform(r, lambda p, i: F.struct(p.alias("a"), F.get(r, (i + 1) % F.size(r)).alias("b"))))


@_bound
def counterclockwise(ring: Column) -> Column:
    return F.when(geometry.turn(boundary(ring)) > 0, F.reverse(ring)).otherwise(ring)


@_bound
def area(ring: Column) -> Column:
    return F.when(F.size(ring) > 2, geometry.area(ring)).otherwise(0.0)


def total_area(rings: Column) -> Column:
    return F.aggregate(F.transform(rings, area), F.lit(0.0), lambda a, x: a + x)


# Relations.


def _cross(p: Column, q: Column) -> Column:
    """Whether two closed edges share a point."""
    a, b, c, d = p["a"], p["b"], q["a"], q["b"]
    side = lambda x: F.signum(x)
    s1, s2, s3, s4 = side(_turn(a, b, c)), side(_turn(a, b, d)), side(_turn(c, d, a)), side(_turn(c, d, b))
    on = lambda e, x: x["x"].between(F.least(e["a"]["x"], e["b"]["x"]), F.greatest(e["a"]["x"], e["b"]["x"])) & x["y"].between(F.least(e["a"]["y"], e["b"]["y"]), F.greatest(e["a"]["y"], e["b"]["y"]))
    touching = ((s1 == 0) & on(p, c)) | ((s2 == 0) & on(p, d)) | ((s3 == 0) & on(q, a)) | ((s4 == 0) & on(q, b))
    return ((s1 * s2 < 0) & (s3 * s4 < 0)) | touching


def _proper(p: Column, q: Column) -> Column:
    """Whether two edges cross within both."""
    a, b, c, d = p["a"], p["b"], q["a"], q["b"]
    return (_turn(a, b, c) * _turn(a, b, d) < 0) & (_turn(c, d, a) * _turn(c, d, b) < 0)


def _any_edges(a: Column, b: Column, test: Callable[[Column, Column], Column]) -> Column:
    return _once(_edges(b), lambda qs: F.exists(_edges(a), lambda p: F.exists(qs, lambda q: test(p, q))))


@_bound
def point_position(ring: Column, x: Column, y: Column, eps: float = 1e-9) -> Column:
    """1 inside, 0 on the border, -1 outside."""
    return F.when(geometry.point_on_border(ring, x, y, eps), 0).when(geometry.point_in_ring(ring, x, y), 1).otherwise(-1)


def _positions(points: Column, ring: Column) -> Column:
    return F.transform(points, lambda p: point_position(ring, p["x"], p["y"]))


def _inside(points: Column, ring: Column) -> Column:
    return F.exists(_positions(points, ring), lambda v: v >= 0)


@_bound
def intersects(a: Column, b: Column) -> Column:
    """Whether closed areas share a point: their edges meet, or one lies in the other."""
    return _any_edges(a, b, _cross) | _inside(F.slice(a, 1, 1), b) | _inside(F.slice(b, 1, 1), a)


def fills(ring: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Whether a ring is its whole box, and the box has an area: two such rings intersect wherever their boxes meet. No loops, so it's compiled."""
    at = lambda i: F.get(ring, F.lit(i))
    n = F.size(ring)
    along = lambda p, q: _all(*[at(i)[p if i % 2 else q] == at((i + 1) % 4)[p if i % 2 else q] for i in range(4)])
    corners = _all(F.least(at(0)["x"], at(2)["x"]) == xmin, F.greatest(at(0)["x"], at(2)["x"]) == xmax, F.least(at(0)["y"], at(2)["y"]) == ymin, F.greatest(at(0)["y"], at(2)["y"]) == ymax)
    return ((n == 4) | ((n == 5) & (at(4) == at(0)))) & (along("x", "y") | along("y", "x")) & corners & (xmin < xmax) & (ymin < ymax)


def disjoint(a: Column, b: Column) -> Column:
    return ~intersects(a, b)


def _middles(ring: Column) -> Column:
    """Points and middles of edges."""
    return F.flatten(F.transform(_edges(ring), lambda e: F.array(_point(e["a"]["x"], e["a"]["y"]), _point((e["a"]["x"] + e["b"]["x"]) / 2, (e["a"]["y"] + e["b"]["y"]) / 2))))


@_bound
def contains(a: Column, b: Column) -> Column:
    """Whether b lies in a, borders included."""
    return ~_any_edges(a, b, _proper) & F.forall(_positions(_middles(b), a), lambda v: v >= 0)


def within(a: Column, b: Column) -> Column:
    return contains(b, a)


@_bound
def overlaps_inside(a: Column, b: Column) -> Column:
    """Whether the insides share a point."""
    some = lambda p, q: F.exists(_positions(_middles(p), q), lambda v: v > 0)
    return _any_edges(a, b, _proper) | some(a, b) | some(b, a) | equals(a, b)


@_bound
def touches(a: Column, b: Column) -> Column:
    """Whether they meet at their borders only."""
    return intersects(a, b) & ~overlaps_inside(a, b)


@_bound
def equals(a: Column, b: Column) -> Column:
    """Whether they cover the same area."""
    return contains(a, b) & contains(b, a)


@_bound
def overlaps(a: Column, b: Column) -> Column:
    """Whether the insides meet and neither contains the other."""
    return overlaps_inside(a, b) & ~contains(a, b) & ~contains(b, a)


def _box(ring: Column) -> Column:
    at = lambda f, c: f(F.transform(ring, lambda p: p[c]))
    return F.struct(at(F.array_min, "x").alias("x0"), at(F.array_min, "y").alias("y0"), at(F.array_max, "x").alias("x1"), at(F.array_max, "y").alias("y1"))


def _apart(a: Column, b: Column, eps: float) -> Column:
    """Whether the boxes of two rings are farther apart than eps along an axis; false for rings without points."""
    far = lambda p, q: (p["x0"] - q["x1"] > eps) | (q["x0"] - p["x1"] > eps) | (p["y0"] - q["y1"] > eps) | (q["y0"] - p["y1"] > eps)
    return F.coalesce(_once(F.struct(_box(a).alias("a"), _box(b).alias("b")), lambda s: far(s["a"], s["b"])), F.lit(False))


RELATIONS = ("intersects", "disjoint", "contains", "within", "touches", "equals", "overlaps")


@_bound
def relations(a: Column, b: Column) -> Column:
    """All of RELATIONS as a struct, NULL where a ring is, else equal to the functions of these names, from parts that are computed once.

    Rings whose boxes are apart are settled by these.
    """

    def named(*values: Column) -> Column:
        return F.struct(*[v.cast("boolean").alias(n) for n, v in zip(RELATIONS, values)])

    def settled(s: Column) -> Column:
        inner = s["proper"] | F.exists(s["of_a"], lambda v: v > 0) | F.exists(s["of_b"], lambda v: v > 0)
        holds, inside = ~s["proper"] & F.forall(s["of_b"], lambda v: v >= 0), ~s["proper"] & F.forall(s["of_a"], lambda v: v >= 0)
        first = lambda at: F.exists(F.slice(at, 1, 1), lambda v: v >= 0)
        return _once(F.struct((s["met"] | first(s["of_a"]) | first(s["of_b"])).alias("meets"), (inner | (holds & inside)).alias("inner"), holds.alias("holds"), inside.alias("inside")), last)

    def last(t: Column) -> Column:
        return named(t["meets"], ~t["meets"], t["holds"], t["inside"], t["meets"] & ~t["inner"], t["holds"] & t["inside"], t["inner"] & ~t["holds"] & ~t["inside"])

    parts = F.struct(_any_edges(a, b, _proper).alias("proper"), _any_edges(a, b, _cross).alias("met"), _positions(_middles(a), b).alias("of_a"), _positions(_middles(b), a).alias("of_b"))
    none, yes = F.lit(False), F.lit(True)
    whole = F.when(_apart(a, b, 1e-6), named(none, yes, none, none, none, none, none)).otherwise(_once(parts, settled))
    return F.when(a.isNotNull() & b.isNotNull(), whole)


@_bound
def crosses(line: Column, ring: Column) -> Column:
    """Whether a line runs both inside and outside of a ring."""
    mids = F.transform(geometry._pairs(line), lambda p: _point((p["a"]["x"] + p["b"]["x"]) / 2, (p["a"]["y"] + p["b"]["y"]) / 2))
    seen = _positions(F.concat(line.cast(_RING), mids), ring)
    met = _once(_edges(ring), lambda qs: F.exists(geometry._pairs(line), lambda p: F.exists(qs, lambda q: _proper(p, q))))
    return met | (F.exists(seen, lambda v: v > 0) & F.exists(seen, lambda v: v < 0))


@_bound
def distance(a: Column, b: Column) -> Column:
    """The least distance of two areas, 0 where they meet."""
    one = lambda p, q: F.array_min(F.transform(p, lambda x: F.array_min(F.transform(_edges(q), lambda e: geometry.segment_distance(e["a"], e["b"], x["x"], x["y"])))))
    return F.when(intersects(a, b), 0.0).otherwise(F.least(one(a, b), one(b, a)))


@_bound
def is_simple(ring: Column) -> Column:
    """Whether no two edges cross, and none that aren't neighbours touch."""

    def clear(es: Column) -> Column:
        n = F.size(es)
        far = lambda i, j: (F.abs(i - j) > 1) & ~((F.least(i, j) == 0) & (F.greatest(i, j) == n - 1))
        bad = F.transform(es, lambda p, i: F.exists(F.transform(es, lambda q, j: F.when(far(i, j), _cross(p, q)).otherwise(_proper(p, q) & (i != j))), lambda v: v))
        return ~F.exists(bad, lambda v: v)

    return _once(_edges(ring), clear)


# Constructions.


@_bound
def convex_hull(points: Column) -> Column:
    """The least convex ring around points, counterclockwise and closed.

    Points are taken in order; of the chain so far, which is convex, what the new point sees from the left falls away. That is a run at its end.
    """

    def chain(ps: Column) -> Column:
        def step(h: Column, p: Column) -> Column:
            kept = F.filter(h, lambda q, j: (j == 0) | (_turn(F.get(h, j - 1), q, p) > 0))
            return F.concat(kept, F.array(p))

        return F.aggregate(ps, F.array().cast(_RING), step)

    def both(ps: Column) -> Column:
        cut = lambda c: F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))
        ring = F.concat(cut(chain(ps)), cut(chain(F.reverse(ps))))
        return F.when(F.size(ps) > 1, _once(ring, lambda r: F.concat(r, F.slice(r, 1, 1)))).otherwise(ps)

    return _once(F.array_sort(F.array_distinct(points.cast(_RING))), both)


@_bound
def half_plane(ring: Column, a: Column, b: Column, left: bool = True) -> Column:
    """The part of a ring on one side of the line through a and b, open."""

    def cut(r: Column) -> Column:
        n = F.size(r)

        def at(p: Column, i: Column) -> Column:
            before = F.get(r, (i + n - 1) % n)
            s, t = _turn(a, b, p), _turn(a, b, before)
            s, t = (s, t) if left else (-s, -t)
            share = t / (t - s)
            met = F.array(_point(before["x"] + share * (p["x"] - before["x"]), before["y"] + share * (p["y"] - before["y"])))
            none = F.array().cast(_RING)
            return F.concat(F.when((s > 0) & (t < 0) | (s < 0) & (t > 0), met).otherwise(none), F.when(s >= 0, F.array(_point(p["x"], p["y"]))).otherwise(none))

        return F.when(n > 0, F.flatten(F.transform(r, at))).otherwise(r)

    return _once(open_ring(ring).cast(_RING), cut)


@_bound
def intersection(ring: Column, convex: Column) -> Column:
    """The part of a ring in a convex one, open; empty where they share no area."""
    edges = _edges(counterclockwise(convex))
    cut = F.aggregate(edges, open_ring(ring).cast(_RING), lambda r, e: half_plane(r, e["a"], e["b"]))
    return F.when(area(cut) > 0, cut).otherwise(F.array().cast(_RING))


@_bound
def difference(ring: Column, convex: Column) -> Column:
    """A ring without a convex one, as rings that don't overlap: for each edge of the convex one, what lies beyond it and inside those before."""
    return F.filter(_split(ring, convex)["out"], lambda r: area(r) > 0)


def _split(ring: Column, convex: Column) -> Column:
    """What of a ring lies in a convex one, as rest, and beyond each of its edges, as out."""
    start = F.struct(open_ring(ring).cast(_RING).alias("rest"), F.array().cast(f"array<{_RING}>").alias("out"))

    def step(a: Column, e: Column) -> Column:
        return F.struct(half_plane(a["rest"], e["a"], e["b"]).alias("rest"), F.concat(a["out"], F.array(half_plane(a["rest"], e["a"], e["b"], False))).alias("out"))

    return F.aggregate(_edges(counterclockwise(convex)), start, step)


@_bound
def union(a: Column, b: Column) -> Column:
    """Two rings as rings that don't overlap; b is convex."""
    return F.concat(F.array(open_ring(b).cast(_RING)), difference(a, b))


@_bound
def symmetric_difference(a: Column, b: Column) -> Column:
    """What lies in one of two convex rings only, as rings that don't overlap."""
    return F.concat(difference(a, b), difference(b, a))


OVERLAYS = ("intersection", "difference", "union", "symmetric_difference")


@_bound
def overlays(a: Column, b: Column) -> Column:
    """All of OVERLAYS of two convex rings as a struct, NULL where a ring is, from one cut of either ring by the other.

    They are what the functions of these names give, but rings whose boxes are apart aren't cut.
    """
    whole = lambda r: F.filter(F.array(open_ring(r).cast(_RING)), lambda x: area(x) > 0)
    clear = lambda rings: F.filter(rings, lambda r: area(r) > 0)
    none = F.array().cast(_RING)

    def cut(s: Column) -> Column:
        return F.struct(F.when(area(s["of_a"]["rest"]) > 0, s["of_a"]["rest"]).otherwise(none).alias("both"), clear(s["of_a"]["out"]).alias("a"), clear(s["of_b"]["out"]).alias("b"))

    def named(p: Column) -> Column:
        found = p["both"], p["a"], F.concat(F.array(open_ring(b).cast(_RING)), p["a"]), F.concat(p["a"], p["b"])
        return F.struct(*[v.alias(n) for n, v in zip(OVERLAYS, found)])

    parts = F.when(_apart(a, b, 0.0), F.struct(none.alias("both"), whole(a).alias("a"), whole(b).alias("b"))).otherwise(_once(F.struct(_split(a, b).alias("of_a"), _split(b, a).alias("of_b")), cut))
    return F.when(a.isNotNull() & b.isNotNull(), _once(parts, named))


@_bound
def offset(points: Column, d: float | Column, closed: bool = False) -> Column:
    """A line moved to its left by d, or a ring with closed; corners are mitred, at most to four times d."""
    d = d if isinstance(d, Column) else F.lit(float(d))

    def moved(r: Column) -> Column:
        n = F.size(r)
        before = lambda i: F.when(F.lit(closed) | (i > 0), F.get(r, (i + n - 1) % n)).otherwise(F.get(r, i))
        after = lambda i: F.when(F.lit(closed) | (i < n - 1), F.get(r, (i + 1) % n)).otherwise(F.get(r, i))

        def unit(p: Column, q: Column) -> tuple[Column, Column]:
            size = F.hypot(q["x"] - p["x"], q["y"] - p["y"])
            return F.when(size > 0, -(q["y"] - p["y"]) / size).otherwise(0.0), F.when(size > 0, (q["x"] - p["x"]) / size).otherwise(0.0)

        def at(p: Column, i: Column) -> Column:
            (ax, ay), (bx, by) = unit(before(i), p), unit(p, after(i))
            (ax, ay), (bx, by) = ((F.when((ax == 0) & (ay == 0), bx).otherwise(ax), F.when((ax == 0) & (ay == 0), by).otherwise(ay)), (F.when((bx == 0) & (by == 0), ax).otherwise(bx), F.when((bx == 0) & (by == 0), ay).otherwise(by)))
            dot = 1 + ax * bx + ay * by
            k = d / F.greatest(dot, F.lit(2.0 / 16))
            return _point(p["x"] + (ax + bx) * k, p["y"] + (ay + by) * k)

        return F.transform(r, at)

    return _once((open_ring(points) if closed else points).cast(_RING), moved)


@_bound
def buffer(convex: Column, d: float | Column, join: str = "round", quarter: int = 8) -> Column:
    """The zone of width d around a convex ring, counterclockwise and open: corners mitred, cut square, or rounded by quarter steps to a right angle."""
    ring = counterclockwise(open_ring(convex))
    d = d if isinstance(d, Column) else F.lit(float(d))
    if join == "miter":
        return offset(ring, -d, True)
    if join not in ("round", "square"):
        raise ValueError(f"no such join: {join}")

    def zone(r: Column) -> Column:
        n = F.size(r)

        def at(p: Column, i: Column) -> Column:
            before, after = F.get(r, (i + n - 1) % n), F.get(r, (i + 1) % n)
            first = F.atan2(p["y"] - before["y"], p["x"] - before["x"]) - math.pi / 2
            turned = F.pmod(F.atan2(after["y"] - p["y"], after["x"] - p["x"]) - math.pi / 2 - first, F.lit(2 * math.pi))
            steps = F.lit(1) if join == "square" else F.greatest(F.lit(1), F.ceil(turned / (math.pi / 2) * quarter - 1e-9)).cast("int")
            return F.transform(F.sequence(F.lit(0), steps), lambda k: _point(p["x"] + d * F.cos(first + turned * k / steps), p["y"] + d * F.sin(first + turned * k / steps)))

        return F.flatten(F.transform(r, at))

    return _once(ring.cast(_RING), zone)


@_bound
def simplify(points: Column, tolerance: float) -> Column:
    """A line without points that lie within tolerance of the chord that replaces them, the farthest point kept first; ends stay.

    Rounds of the same rule instead of a recursion: each round keeps the farthest point of every chord that has one beyond tolerance. Rounds end
    the expression at ROUNDS; a line needs about the logarithm of its points.
    """

    def round_(kept: Column, ps: Column) -> Column:
        spans = F.transform(F.slice(kept, F.lit(1), F.size(kept) - 1), lambda s, i: F.struct(s.alias("a"), F.get(kept, i + 1).alias("b")))

        def farthest(s: Column) -> Column:
            inner = F.filter(F.transform(F.sequence(s["a"], s["b"]), lambda k: F.struct(geometry.segment_distance(F.get(ps, s["a"]), F.get(ps, s["b"]), F.get(ps, k)["x"], F.get(ps, k)["y"]).alias("d"), (-k).alias("k"))), lambda v: v["d"] > tolerance)
            return F.when(F.size(inner) > 0, F.array(-F.array_max(inner)["k"])).otherwise(F.array().cast("array<int>"))

        return F.array_sort(F.concat(kept, F.flatten(F.transform(spans, farthest))))

    def run(ps: Column) -> Column:
        start = F.array(F.lit(0), F.size(ps) - 1)
        kept = F.aggregate(F.sequence(F.lit(1), F.least(F.size(ps), F.lit(ROUNDS))), start, lambda k, _: round_(k, ps))
        return F.when(F.size(ps) > 2, F.transform(kept, lambda i: F.get(ps, i))).otherwise(ps)

    return _once(points.cast(_RING), run)


ROUNDS = 64


# Along lines.


@_bound
def point_along(points: Column, d: float | Column) -> Column:
    """The point at a distance along a line; its ends beyond them."""
    d = d if isinstance(d, Column) else F.lit(float(d))

    def found(ps: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("gone"), F.get(ps, F.lit(0)).alias("p"))

        def step(a: Column, e: Column) -> Column:
            size = F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])
            share = F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (d - a["gone"]) / size))).otherwise(0.0)
            here = _point(e["a"]["x"] + share * (e["b"]["x"] - e["a"]["x"]), e["a"]["y"] + share * (e["b"]["y"] - e["a"]["y"]))
            return F.struct((a["gone"] + size).alias("gone"), F.when(d > a["gone"], here).otherwise(a["p"]).alias("p"))

        return F.aggregate(geometry._pairs(ps), start, step)["p"]

    return _once(points.cast(_RING), found)
