"""Searches over arriving rows. Filters compile to the same plan for a stream as for a table; there are no streaming operators besides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.workspace import Workspace
from ..plans.compiler import compile_query
from ..plans.filters import QueryFilter
from ..plans.model import Fields, TableMeta


def search_stream(rows: DataFrame, meta: TableMeta, query: QueryFilter, workspace: Workspace) -> DataFrame:
    """The arriving rows that a filter describes; its joins are with the workspace's tables."""
    return compile_query(rows, TableMeta(meta.name, meta.oid, meta.kind, meta.shape, meta.geometry, meta.box, Fields.of(rows.schema)), query, lambda n: workspace.table(n).df)


def insert_stream(rows: DataFrame, workspace: Workspace, table: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch goes into a stored table as one transaction."""

    def put(batch: DataFrame, _: int) -> None:
        with workspace.transaction() as t:
            t.insert(table, batch)

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
