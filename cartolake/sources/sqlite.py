"""SQLite files as a Spark data source, by Python's own library; tables are dealt to tasks by ranges of rowid.

Options: path, table, and rows of a task. Files are read from a path that all executors see.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.model import DataType, Field, Fields

#: Declared types and what they are read as; a table's other types are text.
_TYPES = {"INTEGER": DataType.INT64, "REAL": DataType.DOUBLE, "TEXT": DataType.STRING, "BLOB": DataType.BLOB}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def tables(path: str) -> list[str]:
    with _open(path) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]


def table_exists(path: str, table: str) -> bool:
    return table in tables(path)


def fields(path: str, table: str) -> Fields:
    """A table's fields as its schema declares them: types, nullability, defaults and keys."""
    with _open(path) as db:
        rows = db.execute(f"PRAGMA table_info({_quoted(table)})").fetchall()
    if not rows:
        raise ValueError(f"{path} has no table {table}")
    return Fields(Field(name, _TYPES.get(kind.upper().split("(")[0], DataType.STRING), nullable=not must and not key, primary_key=bool(key), default=default) for _, name, kind, must, default, key in rows)


@dataclass
class _Rows(InputPartition):
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType, size: int) -> None:
        self.path, self.table, self.schema, self.size = path, table, schema, size

    def partitions(self) -> list[_Rows]:
        with _open(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [_Rows(0, 0)]
        return [_Rows(k, min(high + 1, k + self.size)) for k in range(low, high + 1, self.size)]

    def read(self, part: _Rows) -> Iterator[tuple]:
        names = ", ".join(_quoted(f.name) for f in self.schema)
        kinds = [{T.LongType: int, T.DoubleType: float, T.StringType: str, T.BinaryType: bytes}[type(f.dataType)] for f in self.schema]

        def value(kind: type, v: object) -> object:
            if v is None or isinstance(v, kind):
                return v
            try:
                return kind(v) if kind is not bytes else str(v).encode()
            except (TypeError, ValueError):
                return None

        with _open(self.path) as db:
            for row in db.execute(f"SELECT {names} FROM {_quoted(self.table)} WHERE rowid >= ? AND rowid < ? ORDER BY rowid", (part.first, part.last)):
                yield tuple(value(k, v) for k, v in zip(kinds, row))


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.struct().dataType) for f in fields(self.options["path"], self.options["table"])])

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options["path"], self.options["table"], schema, int(self.options.get("rows", 100_000)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)
