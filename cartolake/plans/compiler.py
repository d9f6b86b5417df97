"""From a filter to a DataFrame: the logical plan of a search.

The box is brought to the table's reference system here, on the driver, so that it reaches the scan as literals over flat columns, which
Parquet's statistics prune. Everything else is one select over joins and filters, left to Catalyst.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, srs
from .filters import Box, QueryFilter
from .model import Fields, JoinOp, JoinType, SpatialRel, TableMeta

_OPS: dict[JoinOp, Callable] = {JoinOp.EQ: operator.eq, JoinOp.NE: operator.ne, JoinOp.LT: operator.lt, JoinOp.LE: operator.le, JoinOp.GT: operator.gt, JoinOp.GE: operator.ge}


def intersects(box: Box, names: tuple[str, str, str, str]) -> Column:
    """Closed intersection of flat box columns with a box."""
    x0, y0, x1, y1 = map(F.col, names)
    return (x1 >= box.xmin) & (x0 <= box.xmax) & (y1 >= box.ymin) & (y0 <= box.ymax)


def within(box: Box, names: tuple[str, str, str, str]) -> Column:
    x0, y0, x1, y1 = map(F.col, names)
    return (x0 >= box.xmin) & (x1 <= box.xmax) & (y0 >= box.ymin) & (y1 <= box.ymax)


def spatial(meta: TableMeta, query: QueryFilter, alias: str) -> Column | None:
    """The box predicate: intersection, or lying within for every other relation; none if no relation is given."""
    if query.box is None or query.relation is SpatialRel.UNDEFINED:
        return None
    box = query.box
    own = meta.geometry.srs if meta.geometry else None
    if box.srs and own and not srs.same(box.srs, own):
        box = Box(*srs.project_box((box.xmin, box.ymin, box.xmax, box.ymax), box.srs, own), own)
    names = tuple(f"`{alias}`.`{n}`" for n in meta.box)
    return (intersects if query.relation is SpatialRel.INTERSECTS else within)(box, names)


def condition(text: str | None) -> str | None:
    """Where text in Spark's dialect: a leading AND is dropped, a leading OR refused, and == outside quotes is =."""
    text = (text or "").strip()
    if re.match(r"or\b", text, re.I):
        raise ValueError("a condition can't begin with OR")
    text = re.sub(r"^and\b\s*", "", text, flags=re.I)
    parts = re.split(r"('(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`)", text)
    return "".join(p if i % 2 else p.replace("==", "=") for i, p in enumerate(parts)) or None


def _column(alias: str, name: str) -> Column:
    return F.col(f"`{alias}`.`{name}`")


def compile_query(table: DataFrame, meta: TableMeta, query: QueryFilter, lookup: Callable[[str], DataFrame]) -> DataFrame:
    """The rows of table that a filter describes. Joined tables are taken by lookup; each is joined with the main table.

    Columns are the filter's fields, or all of the table's, then each join's; a name that occurs again gets its table's prefix before it.
    """
    main = query.prefix or meta.name
    plan = table.alias(main)
    if (box := spatial(meta, query, main)) is not None:
        plan = plan.where(box)
    fields = Fields.of(table.schema)

    def name(of: Fields, wanted: str) -> str:
        if (i := of.find(wanted)) < 0:
            raise ValueError(f"no field {wanted}")
        return of[i].name

    chosen = [(main, name(fields, f)) for f in query.fields] or [(main, f.name) for f in fields]
    for join in query.joins:
        other = lookup(join.table)
        alias = join.prefix or join.table
        own = Fields.of(other.schema)
        on = _OPS[join.op](_column(alias, name(own, join.first)), _column(main, name(fields, join.second)))
        plan = plan.join(other.alias(alias), on, join.type.value)
        chosen += [(alias, name(own, f)) for f in join.fields]
    if (where := condition(query.where)) is not None:
        plan = plan.where(F.expr(where))
    if not chosen:
        raise ValueError("a query needs at least one field")
    seen: set[str] = set()
    out = []
    for alias, f in chosen:
        shown = f if f.lower() not in seen else f"{alias}_{f}"
        while shown.lower() in seen:
            shown += "_"
        seen.add(shown.lower())
        column = _column(alias, f)
        if alias == main and f == meta.shape:
            own = meta.geometry.srs if meta.geometry else None
            if query.out_srs and own and not srs.same(query.out_srs, own):
                column = geometry.transform(column, own, query.out_srs)
            if query.tolerance > 0:
                column = geometry.thin(column, query.tolerance)
        out.append(column.alias(shown))
    return plan.select(*out)


__all__ = ["JoinType", "compile_query", "condition", "intersects", "spatial", "within"]
