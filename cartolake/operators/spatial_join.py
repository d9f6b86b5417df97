"""Joins of two tables of boxes, and of shapes by their boxes and then exactly.

Boxes are dealt over the cells of grids, meet by an equi-join on the cell, and the pair is kept in the one cell that holds the lower left
corner of what they share, so that it comes once without a distinct. A grid's cells have a level for their width and one for their height. A
box's own levels are the least whose cells are at least its own size, so that it touches four cells at most, however large or flat it is; a
pair is looked for in the grid of the greater level of both on either axis, and boxes are dealt to those grids only that a pair may need.
Levels grow by GROWTH from one to the next; an axis along which a box is beyond the last level, infinite ones included, has one cell. Cells
where many meet are cut into blocks (joins.even), so that tasks are of one size however the boxes lie.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import joins

BOX = ("xmin", "ymin", "xmax", "ymax")
GROWTH, LEAST, LAST = 8, -6, 16
_AXES = ("x", "y")


def _levelled(df: DataFrame, cell: float) -> DataFrame:
    """Whole boxes with their own levels."""
    known = df.where(" and ".join(f"{c} is not null" for c in BOX) + " and xmin <= xmax and ymin <= ymax")
    for r in _AXES:
        low, high = F.col(f"{r}min"), F.col(f"{r}max")
        size = F.greatest((high - low) / cell, F.lit(float(GROWTH) ** LEAST))
        far = F.greatest(F.abs(low), F.abs(high)) > cell * 1e12
        level = F.ceil(F.log(size) / F.log(F.lit(float(GROWTH))) - 1e-9)
        known = known.withColumn(f"_own_{r}", F.when(far | (level >= LAST), LAST).otherwise(level).cast("int"))
    return known


def _used(df: DataFrame) -> DataFrame:
    return df.select("_own_x", "_own_y").distinct()


def _dealt(df: DataFrame, cell: float, own: set[tuple[int, int]], others: set[tuple[int, int]]) -> DataFrame:
    """Rows for each cell that they touch of each grid that a pair with the others' levels needs."""
    grids = sorted({(x, y, max(x, u), max(y, v)) for x, y in own for u, v in others})  # the square of the levels' combinations at most
    wanted = df.sparkSession.createDataFrame(grids, "_own_x int, _own_y int, _level_x int, _level_y int")
    placed = df.join(F.broadcast(wanted), ["_own_x", "_own_y"])
    for r in _AXES:
        span = F.sequence(_cell(F.col(f"{r}min"), F.col(f"_level_{r}"), cell), _cell(F.col(f"{r}max"), F.col(f"_level_{r}"), cell))
        placed = placed.withColumn(f"_c{r}", F.explode(F.when(F.col(f"_level_{r}") == LAST, F.array(F.lit(0).cast("long"))).otherwise(span)))
    return placed


def _cell(value: Column, level: Column, cell: float) -> Column:
    return F.floor(value / (F.lit(float(cell)) * F.pow(F.lit(float(GROWTH)), level)))


def meet(a: str, b: str) -> Column:
    c = lambda t, n: F.col(f"{t}.{n}")
    return (c(a, "xmax") >= c(b, "xmin")) & (c(a, "xmin") <= c(b, "xmax")) & (c(a, "ymax") >= c(b, "ymin")) & (c(a, "ymin") <= c(b, "ymax"))


def join(a: DataFrame, b: DataFrame, cell: float, exact: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None) -> DataFrame:
    """Pairs of rows whose closed boxes meet, as a_* and b_* columns. Boxes with nulls meet nothing.

    exact, a condition on the columns of a and b, is asked of pairs whose boxes meet only.
    """
    left, right = _levelled(a, cell), _levelled(b, cell)
    found = _used(left).withColumn("_side", F.lit(0)).union(_used(right).withColumn("_side", F.lit(1))).collect()  # two rows for each pair of levels at most
    own, others = ({(r["_own_x"], r["_own_y"]) for r in found if r["_side"] == k} for k in (0, 1))
    keys = ["_level_x", "_level_y", "_cx", "_cy"]
    left, right, keys = joins.even(_dealt(left, cell, own, others), _dealt(right, cell, others, own), keys)
    left, right = left.alias("a"), right.alias("b")
    same, kept = F.lit(True), meet("a", "b")
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    for r in _AXES:
        level = F.col(f"a._level_{r}")
        corner = F.col(f"a._c{r}") == _cell(F.greatest(f"a.{r}min", f"b.{r}min"), level, cell)
        kept = kept & (F.greatest(f"a._own_{r}", f"b._own_{r}") == level) & ((level == LAST) | corner)
    if exact is not None:  # one expression, whose parts the optimizer can't put in another order
        kept = F.when(kept, exact(lambda c: F.col(f"a.`{c}`"), lambda c: F.col(f"b.`{c}`"))).otherwise(False)
    pairs = left.join(right, same & kept)
    return pairs.select(*[F.col(f"a.`{c}`").alias(f"a_{c}") for c in a.columns], *[F.col(f"b.`{c}`").alias(f"b_{c}") for c in b.columns])


def counts(a: DataFrame, b: DataFrame, cell: float, name: str = "n") -> DataFrame:
    """b's rows that a's boxes meet, with the number of these.

    Equal boxes of either table are joined once, with their number, so the pairs are those of different boxes; they are summed where they come.
    """
    boxes = a.groupBy(*BOX).agg(F.count("*").alias("_n"))
    met = join(boxes, b.select(*BOX).distinct(), cell).groupBy(*[F.col(f"b_{c}").alias(c) for c in BOX]).agg(F.sum("a__n").alias(name))
    return b.join(met, list(BOX)).select(*b.columns, name)


def join_shapes(a: DataFrame, b: DataFrame, cell: float, relation: Callable[[Column, Column], Column], shape: str = "shape", fills: Callable[..., Column] | None = None) -> DataFrame:
    """Pairs of rows whose shapes are in a relation that holds for meeting boxes only, such as topology.intersects of their rings.

    fills tells from a shape and its box whether the relation holds for two such shapes as soon as their boxes meet, as it does for intersects of
    shapes that fill their boxes; such pairs aren't asked again. It is computed once a row.
    """
    if fills is None:
        return join(a, b, cell, lambda p, q: relation(p(shape), q(shape)))
    told = lambda df: df.withColumn("_fills", F.coalesce(fills(*map(F.col, (shape, *BOX))), F.lit(False)))
    return join(told(a), told(b), cell, lambda p, q: F.when(p("_fills") & q("_fills"), True).otherwise(relation(p(shape), q(shape)))).drop("a__fills", "b__fills")
