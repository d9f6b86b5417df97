"""Declarative queries: immutable filters and joins."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from .model import JoinOp, JoinType, SpatialRel


@dataclass(frozen=True)
class Box:
    """A query box in a reference system; None stands for the table's own."""

    xmin: float
    ymin: float
    xmax: float
    ymax: float
    srs: str | None = None


@dataclass(frozen=True)
class Join:
    """A table joined to the main one on `first op second`: first is the joined table's field, second the main table's.

    Without fields a join contributes no columns.
    """

    table: str
    first: str
    second: str
    type: JoinType = JoinType.INNER
    op: JoinOp = JoinOp.EQ
    fields: tuple[str, ...] = ()
    prefix: str | None = None

    def to_dict(self) -> dict[str, Any]:
        return {"table": self.table, "first": self.first, "second": self.second, "type": self.type.name, "op": self.op.name, "fields": list(self.fields), "prefix": self.prefix}

    @staticmethod
    def from_dict(d: dict[str, Any]) -> Join:
        return Join(d["table"], d["first"], d["second"], JoinType[d["type"]], JoinOp[d["op"]], tuple(d["fields"]), d["prefix"])


@dataclass(frozen=True)
class QueryFilter:
    """Fields, where text, joins, prefix, box and relation, output reference system, tolerance and object ids of one query."""

    fields: tuple[str, ...] = ()
    where: str | None = None
    joins: tuple[Join, ...] = ()
    prefix: str | None = None
    box: Box | None = None
    relation: SpatialRel = SpatialRel.UNDEFINED
    out_srs: str | None = None
    tolerance: float = 0.0

    def with_fields(self, *names: str) -> QueryFilter:
        return replace(self, fields=tuple(dict.fromkeys((*self.fields, *names))))

    def with_where(self, text: str | None) -> QueryFilter:
        return replace(self, where=text)

    def with_prefix(self, prefix: str | None) -> QueryFilter:
        return replace(self, prefix=prefix)

    def with_join(self, join: Join) -> QueryFilter:
        return replace(self, joins=(*self.joins, join))

    def with_box(self, box: Box | None, relation: SpatialRel = SpatialRel.INTERSECTS) -> QueryFilter:
        return replace(self, box=box, relation=relation)

    def with_out_srs(self, srs: str | None) -> QueryFilter:
        return replace(self, out_srs=srs)

    def with_tolerance(self, tolerance: float) -> QueryFilter:
        return replace(self, tolerance=tolerance)
