"""Workspaces: named tables that are created, searched, inserted into and saved.

A workspace keeps its tables in memory, as the DataFrames they are, or in a folder, one Parquet folder a table and one JSON document. A stored
table is a list of parts. A transaction writes new part folders first; its commit takes the workspace's lock, reads the document anew,
changes the touched tables only and replaces the document by one rename, so readers see all of it or nothing. A part that another transaction
has replaced meanwhile, or a primary key that it has added, is a conflict and changes nothing. Parts that are no longer listed stay for RETAIN
seconds, for readers that planned with them, and are removed by later commits or by vacuum().
"""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from types import TracebackType
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bbox
from ..functions.strings import default_value
from ..plans.compiler import compile_query, condition
from ..plans.filters import QueryFilter
from ..plans.model import DatasetType, DataType, Field, Fields, GeometryDef, TableMeta, TransactionType
from . import oidset

BOX = ("xmin", "ymin", "xmax", "ymax")
#: Seconds that replaced parts are kept, that a writer waits for another's lock, and after which a lock is taken for a dead writer's.
RETAIN, BUSY, STALE = 24 * 3600.0, 10.0, 120.0
_LOCKS: dict[str, threading.Lock] = defaultdict(threading.Lock)


class ConflictError(RuntimeError):
    """Another transaction has changed what this one builds on; it has to be done anew."""


class BusyError(RuntimeError):
    """Another writer has held the workspace's lock for too long."""


@dataclass
class Counter:
    """What one kind of operation has done so far."""

    count: int = 0
    bytes: int = 0
    seconds: float = 0.0


class Table:
    """One table of a workspace."""

    def __init__(self, workspace: Workspace, meta: TableMeta, df: DataFrame | None = None) -> None:
        self.workspace, self.meta, self._df = workspace, meta, df

    @property
    def df(self) -> DataFrame:
        return self._df if self._df is not None else self.workspace._read(self.meta)

    @property
    def fields(self) -> Fields:
        return Fields.of(self.df.schema)

    def search(self, query: QueryFilter | None = None) -> DataFrame:
        """The rows that a filter describes; all of them without one."""
        return compile_query(self.df, self.meta, query or QueryFilter(), lambda name: self.workspace.table(name).df)

    def select(self, sql: str) -> DataFrame:
        """A query in Spark's dialect over the workspace's tables."""
        return self.workspace.select(sql)

    def extent(self) -> DataFrame:
        return bbox.extent(self.df, names=self.meta.box)

    def count(self) -> int:
        return self.df.count()

    def with_oids(self, oids: DataFrame) -> DataFrame:
        return oidset.rows_in(self.df, oids, self.meta.oid)


class Workspace:
    def __init__(self, spark: SparkSession, name: str, path: str | None = None) -> None:
        self.spark, self.name, self.path, self.guid = spark, name, path.rstrip("/") if path else None, str(uuid.uuid4())
        self.tables: dict[str, Table] = {}
        self.counters: dict[str, Counter] = defaultdict(Counter)
        self._parts: dict[str, list[str]] = {}
        self.refresh()

    def refresh(self) -> None:
        """Take the stored tables as the document has them now."""
        if self.path and self._exists(f"{self.path}/workspace.json"):
            self._load(json.loads(self._text(f"{self.path}/workspace.json")))

    # Files, by way of Hadoop, so that any store will do.

    def _fs(self, path: str) -> tuple[Any, Any]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _text(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _size(self, path: str) -> int:
        fs, p = self._fs(path)
        return fs.getContentSummary(p).getLength()

    def _put(self, path: str, text: str) -> None:
        """Write a file beside the target and rename it over that, in one step where the store can."""
        fs, p = self._fs(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(p, jvm.org.apache.hadoop.fs.Path(path), options)

    def _remove(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _read(self, meta: TableMeta, parts: list[str] | None = None) -> DataFrame:
        parts = self._parts.get(meta.name, []) if parts is None else parts
        schema = meta.fields.schema()
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in parts]) if parts else self.spark.createDataFrame([], schema)

    @contextmanager
    def _locked(self) -> Iterator[None]:
        """One writer at a time, in this process and, by a lock file, among all."""
        fs, p = self._fs(f"{self.path}/workspace.lock")
        until = time.monotonic() + BUSY
        if not _LOCKS[self.path].acquire(timeout=BUSY):
            raise BusyError(f"{self.name} is being written")
        try:
            while True:
                try:
                    fs.create(p, False).close()
                    break
                except Py4JJavaError:
                    if not fs.exists(p):
                        continue
                    if time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > STALE:
                        fs.delete(p, False)
                    elif time.monotonic() > until:
                        raise BusyError(f"{self.name} is being written") from None
                    time.sleep(0.05)
            try:
                yield
            finally:
                fs.delete(p, False)
        finally:
            _LOCKS[self.path].release()

    def _change(self, edit: Callable[[dict[str, Any]], None]) -> None:
        """Edit the stored document under the lock, as it is now, and take it over."""
        with self._locked():
            path = f"{self.path}/workspace.json"
            doc = json.loads(self._text(path)) if self._exists(path) else {"name": self.name, "guid": self.guid, "version": 0, "tables": [], "retired": []}
            before = {p for t in doc["tables"] for p in t["parts"]}
            edit(doc)
            doc["version"] = doc.get("version", 0) + 1
            now = time.time()
            gone = before - {p for t in doc["tables"] for p in t["parts"]}
            retired = [r for r in doc.get("retired", []) if now - r["at"] <= RETAIN]
            old = [r["part"] for r in doc.get("retired", []) if now - r["at"] > RETAIN]
            doc["retired"] = retired + [{"part": p, "at": now} for p in sorted(gone)]
            self._put(path, json.dumps(doc))
        for part in old:
            self._remove(f"{self.path}/{part}")
        self._load(doc)

    def vacuum(self, older: float = RETAIN) -> int:
        """Remove the parts that were replaced more than older seconds ago; returns how many."""
        found: list[str] = []

        def edit(doc: dict[str, Any]) -> None:
            found.extend(r["part"] for r in doc.get("retired", []) if time.time() - r["at"] > older)
            doc["retired"] = [r for r in doc.get("retired", []) if r["part"] not in found]

        self._change(edit)
        for part in found:
            self._remove(f"{self.path}/{part}")
        return len(found)

    @contextmanager
    def counted(self, operation: str) -> Iterator[Counter]:
        """Count one operation and its seconds; the block adds the bytes."""
        counter, began = self.counters[operation], time.perf_counter()
        try:
            yield counter
        finally:
            counter.count += 1
            counter.seconds += time.perf_counter() - began

    # Datasets.

    def add(self, name: str, df: DataFrame, oid: str = "oid", shape: str | None = None, geometry: GeometryDef | None = None, box: tuple[str, str, str, str] = BOX) -> Table:
        """Take a DataFrame as a table; it is searched as it is, not copied."""
        if name in self.tables:
            raise ValueError(f"table {name} is there already")
        spatial = all(b in df.columns for b in box)
        meta = TableMeta(name, oid, DatasetType.SPATIAL_TABLE if spatial else DatasetType.TABLE, shape, geometry, box, Fields.of(df.schema))
        self.tables[name] = Table(self, meta, df)
        df.createOrReplaceTempView(name)
        return self.tables[name]

    def exists(self, name: str) -> bool:
        return name in self.tables or self.spark.catalog.tableExists(name)

    def table(self, name: str) -> Table:
        """A table by name; one that only Spark's catalog has is taken from there."""
        if name not in self.tables:
            if not self.spark.catalog.tableExists(name):
                raise KeyError(name)
            df = self.spark.table(name)
            self.tables[name] = Table(self, TableMeta(name, fields=Fields.of(df.schema)), df)
        return self.tables[name]

    def remove(self, name: str) -> None:
        """Drop a table; a stored one's parts stay for readers as after a change."""
        stored = name in self._parts
        del self.tables[name]
        self._parts.pop(name, None)
        self.spark.catalog.dropTempView(name)
        if stored:
            self._change(lambda doc: doc.update(tables=[t for t in doc["tables"] if t["name"] != name]))

    def create_table(self, name: str, fields: Iterable[Field], oid: str | None = None) -> Table:
        """A stored table. Fields that are primary keys, not null or have defaults are held to that on insert."""
        fields = Fields(fields)
        if not fields:
            raise ValueError("a table needs fields")
        if not self.path:
            raise ValueError("a workspace without a folder can't store tables")
        if self.exists(name):
            raise ValueError(f"table {name} is there already")
        shape = next((f for f in fields if f.type is DataType.GEOMETRY), None)
        kind = DatasetType.TABLE
        if shape:
            kind = DatasetType.SPATIAL_TABLE
            fields = Fields([*fields, *[Field(b, DataType.DOUBLE) for b in BOX if fields.find(b) < 0]])
        oid = oid or next((f.name for f in fields if f.primary_key), fields[0].name)
        made = self._described(TableMeta(name, oid, kind, shape.name if shape else None, shape.geometry if shape else None, BOX, fields), [])

        def edit(doc: dict[str, Any]) -> None:
            if any(t["name"] == name for t in doc["tables"]):
                raise ValueError(f"table {name} is there already")
            doc["tables"].append(made)

        self._change(edit)
        return self.tables[name]

    create_spatial_table = create_table

    def select(self, sql: str) -> DataFrame:
        for name, t in self.tables.items():
            t.df.createOrReplaceTempView(name)
        return self.spark.sql(condition(sql) or sql)

    def execute(self, sql: str) -> DataFrame | int:
        """A statement: INSERT, UPDATE, DELETE, CREATE TABLE and DROP TABLE of stored tables give the rows they changed, all else is a query.

        A table that isn't stored can't be changed; what isn't one of these forms goes to Spark.
        """
        from .statements import run

        return run(self, sql)

    def transaction(self, kind: TransactionType = TransactionType.MODIFY) -> Transaction:
        return Transaction(self, kind)

    # Documents.

    @staticmethod
    def _described(m: TableMeta, parts: list[str]) -> dict[str, Any]:
        def field(f: Field) -> dict[str, Any]:
            g = f.geometry
            return {"name": f.name, "type": f.type.name, "alias": f.alias, "nullable": f.nullable, "editable": f.editable, "required": f.required, "pk": f.primary_key, "length": f.length, "precision": f.precision, "scale": f.scale, "default": f.default, "geometry": g and {"shape_type": g.shape_type, "has_z": g.has_z, "has_m": g.has_m, "srs": g.srs, "extent": g.extent}}

        return {"name": m.name, "oid": m.oid, "kind": int(m.kind), "shape": m.shape, "fields": [field(f) for f in m.fields], "parts": parts}

    def document(self) -> dict[str, Any]:
        stored = {n: t.meta for n, t in self.tables.items() if n in self._parts}
        return {"name": self.name, "guid": self.guid, "tables": [self._described(m, self._parts[n]) for n, m in stored.items()]}

    def _load(self, doc: dict[str, Any]) -> None:
        self.name, self.guid = doc["name"], doc["guid"]
        there = {t["name"] for t in doc["tables"]}
        for name in set(self._parts) - there:
            self.tables.pop(name, None)
            del self._parts[name]
        for t in doc["tables"]:
            fields = Fields()
            for f in t["fields"]:
                g = f["geometry"]
                fields.append(Field(f["name"], DataType[f["type"]], f["alias"], f["nullable"], f["editable"], f["required"], f["pk"], f["length"], f["precision"], f["scale"], f["default"], GeometryDef(g["shape_type"], g["has_z"], g["has_m"], g["srs"], tuple(g["extent"]) if g["extent"] else None) if g else None))
            shape = next((f for f in fields if f.name == t["shape"]), None)
            self.tables[t["name"]] = Table(self, TableMeta(t["name"], t["oid"], DatasetType(t["kind"]), t["shape"], shape.geometry if shape else None, BOX, fields))
            self._parts[t["name"]] = list(t["parts"])

    def observe(self, df: DataFrame, label: str) -> tuple[DataFrame, Any]:
        """df with its rows counted as it runs; the observation has rows afterwards."""
        from pyspark.sql import Observation

        seen = Observation(label)
        return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


_PART = re.compile(r"part-[0-9a-f]{32}")


class Transaction:
    """Inserts, updates and deletes of stored tables that all take effect at commit. Leaving its block by an error rolls back.

    It sees the tables as they were when it touched them first, and its own changes. Changes rewrite only the parts that hold their rows.
    """

    def __init__(self, workspace: Workspace, kind: TransactionType = TransactionType.MODIFY) -> None:
        if not workspace.path:
            raise ValueError("a workspace without a folder has no transactions")
        self.workspace, self.kind = workspace, kind
        self._base: dict[str, list[str]] = {}
        self._parts: dict[str, list[str]] = {}
        self._inserted: set[str] = set()  # tables whose primary keys have to be unlike those of others' new parts
        self._new: list[str] = []
        self._open = True

    def _check(self) -> None:
        if not self._open:
            raise ValueError("the transaction has ended")
        if self.kind is TransactionType.SELECT:
            raise ValueError("the transaction is for reading only")

    def _touch(self, name: str) -> TableMeta:
        if name not in self.workspace._parts:
            raise KeyError(name)
        if name not in self._parts:
            self._base[name] = list(self.workspace._parts[name])
            self._parts[name] = list(self._base[name])
        return self.workspace.tables[name].meta

    def _current(self, name: str) -> DataFrame:
        return self.workspace._read(self.workspace.tables[name].meta, self._parts[name])

    def _stage(self, name: str, df: DataFrame, operation: str) -> str:
        part = f"{name}/part-{uuid.uuid4().hex}"
        self._new.append(part)
        with self.workspace.counted(operation) as counter:
            df.write.parquet(f"{self.workspace.path}/{part}")
            counter.bytes += self.workspace._size(f"{self.workspace.path}/{part}")
        return part

    def _conform(self, meta: TableMeta, df: DataFrame) -> DataFrame:
        """df's columns as the table has them: missing ones by default, boxes from shapes, types cast. Spatial tables are put in order of place."""
        have = {c.lower(): c for c in df.columns}
        if unknown := set(have) - {f.name.lower() for f in meta.fields}:
            raise ValueError(f"{meta.name} has no fields {sorted(unknown)}")
        out = []
        for f in meta.fields:
            kind = f.struct().dataType
            if meta.shape and f.name in BOX:
                end, axis = f.name[1:].capitalize(), f.name[0]
                out.append(F.when(F.col(meta.shape)["bbox"]["type"] == bbox.NORMAL, F.col(meta.shape)["bbox"][f"{axis}{end}"]).alias(f.name))
            elif f.name.lower() in have:
                out.append(F.col(f"`{have[f.name.lower()]}`").cast(kind).alias(f.name))
            else:
                out.append(default_value(None if f.default is None else str(f.default), kind.simpleString()).alias(f.name))
        made = df.select(*out)
        needed = [f.name for f in meta.fields if not f.nullable or f.primary_key or f.required]
        for n in needed:
            made = made.withColumn(n, F.coalesce(F.col(n), F.raise_error(F.lit(f"{meta.name}.{n} can't be null")).cast(made.schema[n].dataType)))
        if meta.shape:
            made = made.sortWithinPartitions(F.floor(F.col("xmin") / 1000), F.floor(F.col("ymin") / 1000), "xmin")
        return made

    def _known(self, name: str, part: str, parts: list[str]) -> bool:
        """Whether a primary key of a part is in others."""
        meta = self.workspace.tables[name].meta
        keys = [f.name for f in meta.fields if f.primary_key]
        if not keys or not parts:
            return False
        new = self.workspace._read(meta, [part])
        return not new.join(self.workspace._read(meta, parts).select(*keys), keys, "left_semi").isEmpty()

    def insert(self, name: str, rows: DataFrame | list[dict[str, Any]]) -> int:
        """Rows put into a table; returns how many. A primary key that occurs twice, here or in the table, is refused."""
        self._check()
        meta = self._touch(name)
        if isinstance(rows, list):
            names = {k for r in rows for k in r}
            if unknown := names - {f.name for f in meta.fields}:
                raise ValueError(f"{name} has no fields {sorted(unknown)}")
            schema = T.StructType([T.StructField(f.name, f.struct().dataType) for f in meta.fields if f.name in names])
            rows = self.workspace.spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)
        part = self._stage(name, self._conform(meta, rows), "insert")
        written = self.workspace._read(meta, [part])
        if keys := [f.name for f in meta.fields if f.primary_key]:
            twice = written.groupBy(*keys).count().where("count > 1")
            if not twice.isEmpty() or self._known(name, part, self._parts[name]):
                raise ValueError(f"a primary key of {name} occurs twice")
        self._parts[name].append(part)
        self._inserted.add(name)
        return written.count()

    def insert_sql(self, name: str, sql: str) -> int:
        """The result of a query put into a table."""
        return self.insert(name, self.workspace.select(sql))

    def _holding(self, name: str, oids: DataFrame) -> list[str]:
        """The parts that hold rows of some object ids: at most one name a part goes to the driver."""
        meta = self.workspace.tables[name].meta
        if not self._parts[name]:
            return []
        placed = self._current(name).select(F.col(meta.oid).alias("_oid"), F.regexp_extract("_metadata.file_path", _PART.pattern, 0).alias("_part"))
        wanted = oids.select(F.col(oids.columns[0]).cast("long").alias("_oid"))
        found = {r["_part"] for r in placed.join(wanted, "_oid", "left_semi").select("_part").distinct().collect()}
        return [p for p in self._parts[name] if p.rsplit("/", 1)[-1] in found]

    def _replace(self, name: str, old: list[str], df: DataFrame, operation: str) -> None:
        part = self._stage(name, df, operation)
        self._parts[name] = [*[p for p in self._parts[name] if p not in old], part]

    def delete(self, name: str, oids: DataFrame | list[int]) -> None:
        self._check()
        meta = self._touch(name)
        if isinstance(oids, list):
            oids = self.workspace.spark.createDataFrame([(o,) for o in oids], "oid long")
        oids = oids.select(F.col(oids.columns[0]).alias("oid"))
        if held := self._holding(name, oids):
            self._replace(name, held, oidset.rows_not_in(self.workspace._read(meta, held), oids, meta.oid), "delete")

    def update(self, name: str, rows: DataFrame) -> None:
        """Rows whose object id is among rows' take the values that rows has; fields that rows lacks stay. An object id may come once only."""
        self._check()
        meta = self._touch(name)
        if not rows.groupBy(meta.oid).count().where("count > 1").isEmpty():
            raise ValueError("an object id comes twice among the new rows")
        held = self._holding(name, rows.select(meta.oid))
        if not held:
            return
        old = self.workspace._read(meta, held)
        new = rows.select(F.col(meta.oid).alias("_oid"), *[F.col(c).alias(f"_{c}") for c in rows.columns if c != meta.oid], F.lit(True).alias("_found"))
        joined = old.join(new, old[meta.oid] == new["_oid"], "left")
        changed = [F.when(F.col("_found"), F.col(f"_{f.name}")).otherwise(F.col(f.name)).alias(f.name) if f.name in rows.columns and f.name != meta.oid else F.col(f.name) for f in meta.fields]
        self._replace(name, held, self._conform(meta, joined.select(*changed)), "update")

    def commit(self) -> None:
        """Make the changes known. Raises ConflictError, and changes nothing, if another transaction has touched the same parts or keys."""
        self._check()

        def edit(doc: dict[str, Any]) -> None:
            tables = {t["name"]: t for t in doc["tables"]}
            for name, base in self._base.items():
                if name not in tables:
                    raise ConflictError(f"table {name} has been dropped")
                now = tables[name]["parts"]
                gone, added = [p for p in base if p not in self._parts[name]], [p for p in self._parts[name] if p not in base]
                if not set(gone) <= set(now):
                    raise ConflictError(f"rows of {name} have been changed by another transaction")
                others = [p for p in now if p not in base]
                if name in self._inserted and any(self._known(name, p, others) for p in added):
                    raise ConflictError(f"a primary key of {name} has been inserted by another transaction")
                tables[name]["parts"] = [*[p for p in now if p not in gone], *added]

        with self.workspace.counted("commit"):
            self.workspace._change(edit)
        self._open = False
        kept = {p for parts in self._parts.values() for p in parts}
        self._drop([p for p in self._new if p not in kept])

    def _drop(self, parts: list[str]) -> None:
        """Remove parts that no document has ever listed."""
        for part in parts:
            self.workspace._remove(f"{self.workspace.path}/{part}")

    def rollback(self) -> None:
        if self._open:
            self._open = False
            self._drop(self._new)

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        try:
            if kind is None and self._open and self.kind is not TransactionType.SELECT:
                self.commit()
        finally:
            self.rollback()
