"""Maps of layers: selection, scans and extents."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import bbox, srs
from ..functions.display import View
from ..plans.compiler import condition, intersects
from ..plans.filters import Box, QueryFilter
from ..plans.model import SpatialRel
from .workspace import Table, Workspace

EMPTY_EXTENT = (-1.0, -1.0, 1.0, 1.0)  # fixed value: the extent of a map without layers


@dataclass(frozen=True)
class Renderer:
    """What draws a layer: its scale range, a hook on the rows it asks for, and its symbols, one or by value of a field."""

    min_scale: float = 0.0
    max_scale: float = 0.0
    prepare: Callable[[DataFrame], DataFrame] | None = None
    symbol: str | None = None
    by_field: str | None = None
    symbols: tuple[tuple[Any, str], ...] = ()

    def visible(self, scale: float) -> bool:
        return (not self.max_scale or scale >= self.max_scale) and (not self.min_scale or scale <= self.min_scale)

    def draw(self, df: DataFrame) -> DataFrame:
        """df as the hook leaves it, with symbol: that of the row's value, or the common one."""
        df = self.prepare(df) if self.prepare else df
        if not (self.symbol or self.by_field):
            return df
        chosen = F.lit(self.symbol)
        for value, symbol in reversed(self.symbols if self.by_field else ()):
            chosen = F.when(F.col(self.by_field) == F.lit(value), symbol).otherwise(chosen)
        return df.withColumn("symbol", chosen)


@dataclass(frozen=True)
class Layer:
    """A table as a map shows it."""

    id: int
    name: str
    table: Table
    visible: bool = True
    selectable: bool = True
    min_scale: float = 0.0
    max_scale: float = 0.0
    definition: str | None = None
    renderers: tuple[Renderer, ...] = ()
    extent: tuple[float, float, float, float] | None = None

    def rows(self) -> DataFrame:
        """The table's rows by the layer's definition query."""
        where = condition(self.definition)
        return self.table.df if where is None else self.table.df.where(where)

    def shows_at(self, scale: float) -> bool:
        own = Renderer(self.min_scale, self.max_scale).visible(scale)
        return own and (not self.renderers or any(r.visible(scale) for r in self.renderers))

    def _own_box(self, box: Box) -> Box | None:
        """The box in the layer's reference system, or None if it is known to miss the layer's extent."""
        own = self.table.meta.geometry.srs if self.table.meta.geometry else None
        if box.srs and own and not srs.same(box.srs, own):
            box = Box(*srs.project_box((box.xmin, box.ymin, box.xmax, box.ymax), box.srs, own), own)
        if self.extent and bbox.envelope_intersect((box.xmin, box.ymin, box.xmax, box.ymax), self.extent) is None:
            return None
        return box

    def select(self, box: Box) -> DataFrame | None:
        """layer_id and oid of the rows that meet a box."""
        own = self._own_box(box)
        if own is None:
            return None
        meta = self.table.meta
        return self.rows().where(intersects(own, meta.box)).select(F.lit(self.id).cast("int").alias("layer_id"), F.col(meta.oid).cast("long").alias("oid"))

    def scan(self, view: View, query: QueryFilter | None = None, map_srs: str | None = None) -> DataFrame | None:
        """The rows that a view shows, as the renderers want them, or None where scale or extent rule the layer out."""
        if not self.shows_at(view.scale):
            return None
        own = self._own_box(Box(*view.extent(), map_srs))
        if own is None:
            return None
        query = (query or QueryFilter()).with_box(own, SpatialRel.INTERSECTS)
        drawn = replace(self.table.meta)
        found = Table(self.table.workspace, drawn, self.rows()).search(query)
        for r in self.renderers:
            if r.visible(view.scale):
                found = r.draw(found)
        return found


@dataclass
class Map:
    name: str
    srs: str | None = None
    layers: list[Layer] = field(default_factory=list)

    # The layers' list; ids are unlike one another.

    def add(self, layer: Layer, at: int | None = None) -> None:
        if any(x.id == layer.id for x in self.layers):
            raise ValueError(f"layer {layer.id} is there already")
        self.layers.insert(len(self.layers) if at is None else at, layer)

    def by_id(self, layer_id: int) -> Layer:
        return next(x for x in self.layers if x.id == layer_id)

    def remove(self, layer_id: int) -> None:
        self.layers.remove(self.by_id(layer_id))

    def move(self, layer_id: int, to: int) -> None:
        layer = self.by_id(layer_id)
        self.layers.remove(layer)
        self.layers.insert(to, layer)

    # Queries.

    def select_features(self, box: Box) -> DataFrame | None:
        """layer_id and oid over all layers that are visible and selectable; None if no layer can have any."""
        parts = [s for x in self.layers if x.visible and x.selectable if (s := x.select(box)) is not None]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def scan(self, view: View) -> dict[int, DataFrame]:
        return {x.id: s for x in self.layers if x.visible if (s := x.scan(view, map_srs=self.srs)) is not None}

    def full_extent(self) -> tuple[float, float, float, float]:
        """The box around all layers, projected to the map's system; one query over their union. A map without any has a fixed one."""
        if not self.layers:
            return EMPTY_EXTENT
        parts = [bbox.extent(x.rows(), names=x.table.meta.box).withColumn("at", F.lit(i)) for i, x in enumerate(self.layers)]
        total = None
        for r in reduce(DataFrame.unionByName, parts).collect():  # one row a layer
            if r["xmin"] is None:
                continue
            box = (r["xmin"], r["ymin"], r["xmax"], r["ymax"])
            g = self.layers[r["at"]].table.meta.geometry
            if self.srs and g and g.srs:
                box = srs.project_box(box, g.srs, self.srs)
            total = bbox.envelope_expand(total, box)
        return total or EMPTY_EXTENT

    # Documents.

    def to_json(self) -> str:
        def layer(x: Layer) -> dict[str, Any]:
            return {"id": x.id, "name": x.name, "table": x.table.meta.name, "visible": x.visible, "selectable": x.selectable, "min_scale": x.min_scale, "max_scale": x.max_scale, "definition": x.definition, "extent": x.extent, "renderers": [{"min_scale": r.min_scale, "max_scale": r.max_scale, "symbol": r.symbol, "by_field": r.by_field, "symbols": r.symbols} for r in x.renderers]}

        return json.dumps({"name": self.name, "srs": self.srs, "layers": [layer(x) for x in self.layers]})

    @staticmethod
    def from_json(text: str, workspace: Workspace) -> Map:
        doc = json.loads(text)
        out = Map(doc["name"], doc["srs"])
        for d in doc["layers"]:
            renderers = tuple(Renderer(r["min_scale"], r["max_scale"], None, r["symbol"], r["by_field"], tuple(map(tuple, r["symbols"]))) for r in d["renderers"])
            out.add(Layer(d["id"], d["name"], workspace.table(d["table"]), d["visible"], d["selectable"], d["min_scale"], d["max_scale"], d["definition"], renderers, tuple(d["extent"]) if d["extent"] else None))
        return out


def until_stopped(df: DataFrame, go_on: Callable[[], bool], every: int = 100) -> Iterator[Row]:
    """Rows one by one as they arrive; every so many rows it is asked whether to go on."""
    for i, row in enumerate(df.toLocalIterator(), 1):
        yield row
        if i % every == 0 and not go_on():
            return
