"""Shapefiles as a Spark data source: .shp, .shx, .dbf and .prj, read and written.

Records are dealt to tasks by ranges of the .shx index. A box given as option rules out whole ranges by a side file of blocks' boxes, which the
writer makes, and single records by their own box before they are decoded. Attributes are read by the record's own number. A path that ends in .shp is
one shapefile, which the driver puts together from the tasks' files; any other is a folder of shapefiles, one a task, so that nothing but the tasks
handles rows. Files are read and written with Python at a path that all executors see; other stores are refused by name.
"""

from __future__ import annotations

import contextlib
import datetime
import math
import os
import pickle
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..plans.model import GEOMETRY

# Fixed values of the format: the files' code, and which shape codes have parts, Z and M.
FILE_CODE, VERSION = 9994, 1000
_POINTS, _MULTI, _PARTED, _PATCH = {1, 11, 21}, {8, 18, 28}, {3, 5, 13, 15, 23, 25}, {31}
_WITH_Z, _WITH_M = {11, 13, 15, 18, 31}, {11, 13, 15, 18, 31, 21, 23, 25, 28}
NO_DATA = -1e38  # measures below it are none
RECORDS = 10_000  # records of a task
BLOCK = 256  # records of a block of the side file


def local(path: str) -> str:
    """A path as Python opens it."""
    found = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]+):(?://[^/]*)?(/.*)", path)
    if found and found[1] != "file":
        raise ValueError(f"shapefiles are read from paths that Python opens, not from {found[1]}:")
    return found[2] if found else path


def _zeros() -> dict:
    return {f"{r}{e}": 0.0 for r in "xyzm" for e in ("Min", "Max")}


def _span(values: list[float]) -> tuple[float, float]:
    return (min(values), max(values)) if values else (0.0, 0.0)


def decode(body: bytes) -> dict | None:
    """A record's content as a geometry; None for the null shape."""
    (code,) = struct.unpack_from("<i", body)
    if code == 0:
        return None
    at = 4
    parts: list[int] = []
    kinds = None
    if code in _POINTS:
        n, flat = 1, list(struct.unpack_from("<2d", body, at))
        at += 16
    else:
        at += 32
        if code in _PARTED | _PATCH:
            n_parts, n = struct.unpack_from("<2i", body, at)
            at += 8
            parts = list(struct.unpack_from(f"<{n_parts}i", body, at))
            at += 4 * n_parts
            if code in _PATCH:
                kinds = list(struct.unpack_from(f"<{n_parts}i", body, at))
                at += 4 * n_parts
        elif code in _MULTI:
            (n,) = struct.unpack_from("<i", body, at)
            at += 4
        else:
            raise ValueError(f"shape type {code}")
        flat = list(struct.unpack_from(f"<{2 * n}d", body, at))
        at += 16 * n

    def extra(has: bool) -> list[float] | None:
        nonlocal at
        head = 0 if code in _POINTS else 16
        if not has or at + head + 8 * n > len(body):
            return None
        values = list(struct.unpack_from(f"<{n}d", body, at + head))
        at += head + 8 * n
        return values

    zs = extra(code in _WITH_Z)
    ms = extra(code in _WITH_M)
    ms = None if ms is None else [None if v < NO_DATA else v for v in ms]
    xs, ys = flat[::2], flat[1::2]
    box = _zeros() | dict(zip(("xMin", "xMax", "yMin", "yMax"), (*_span(xs), *_span(ys)))) | {"type": 2 if n else 0}
    if zs:
        box["zMin"], box["zMax"] = _span(zs)
    if ms and any(v is not None for v in ms):
        box["mMin"], box["mMax"] = _span([v for v in ms if v is not None])
    return {"type": code, "bbox": box, "parts": parts, "part_types": kinds, "points": [{"x": x, "y": y} for x, y in zip(xs, ys)], "zs": zs, "ms": ms}


def encode(g: dict | Row | None) -> bytes:
    """A geometry as a record's content."""
    if g is None or not g["type"]:
        return struct.pack("<i", 0)
    code, points = g["type"], g["points"]
    flat = [v for p in points for v in (p["x"], p["y"])]
    zs, ms = g["zs"] or [0.0] * len(points), [NO_DATA * 10 if v is None else v for v in (g["ms"] or [None] * len(points))]
    if code in _POINTS:
        out = struct.pack("<i2d", code, *flat)
        return out + (struct.pack("<d", zs[0]) if code in _WITH_Z else b"") + (struct.pack("<d", ms[0]) if code in _WITH_M else b"")
    (x0, x1), (y0, y1) = _span(flat[::2]), _span(flat[1::2])
    out = struct.pack("<i4d", code, x0, y0, x1, y1)
    if code in _PARTED | _PATCH:
        parts = list(g["parts"]) or [0]
        out += struct.pack(f"<2i{len(parts)}i", len(parts), len(points), *parts)
        out += struct.pack(f"<{len(parts)}i", *g["part_types"]) if code in _PATCH else b""
    else:
        out += struct.pack("<i", len(points))
    out += struct.pack(f"<{len(flat)}d", *flat)
    for has, values in ((code in _WITH_Z, zs), (code in _WITH_M, ms)):
        if has:
            out += struct.pack(f"<{2 + len(values)}d", *_span([v for v in values if v > NO_DATA] or [0.0]), *values)
    return out


@dataclass(frozen=True)
class _Column:
    name: str
    kind: str
    length: int
    decimals: int
    at: int

    def type(self) -> T.DataType:
        if self.kind in "NF":
            if self.decimals:
                return T.DoubleType()
            return T.LongType() if self.length >= 10 else T.IntegerType()
        return {"D": T.DateType(), "L": T.BooleanType()}.get(self.kind, T.StringType())

    def value(self, raw: bytes, charset: str) -> object:
        text = raw[self.at : self.at + self.length].decode(charset, "replace").strip("\0 ")
        if not text or set(text) == {"*"}:
            return None if self.kind != "C" else text or None
        try:
            if self.kind in "NF":
                return float(text) if self.decimals else int(float(text))
            if self.kind == "D":
                return datetime.date(int(text[:4]), int(text[4:6]), int(text[6:8]))
        except ValueError:
            return None
        return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper()) if self.kind == "L" else text


def _dbf(path: str) -> tuple[int, int, int, list[_Column]]:
    """Records, header length, record length and columns."""
    with open(path, "rb") as f:
        head = f.read(32)
        n, start, width = struct.unpack_from("<IHH", head, 4)
        columns, at = [], 1
        while (entry := f.read(32)) and entry[0] != 0x0D:
            name = entry[:11].split(b"\0")[0].decode("latin-1")
            columns.append(_Column(name, chr(entry[11]), entry[16], entry[17], at))
            at += entry[16]
    return n, start, width, columns


def _free(name: str, taken: set[str]) -> str:
    """A column name that isn't taken: with a number after it if need be."""
    shown, k = name, 0
    while shown.lower() in taken:
        shown, k = f"{name}{k}", k + 1
    return shown


def schema_of(path: str) -> T.StructType:
    """The columns of a shapefile, or of the first of a folder."""
    bases = _bases(path)
    if not bases:
        raise ValueError(f"no shapefile in {path}")
    base = bases[0]
    columns = _dbf(f"{base}.dbf")[3] if os.path.exists(f"{base}.dbf") else []
    fields = [T.StructField(c.name, c.type(), True, {"length": c.length, "scale": c.decimals}) for c in columns]
    taken = {c.name.lower() for c in columns}
    own = [(_free("oid", taken), T.LongType()), (_free("Shape", taken), GEOMETRY), *[(_free(n, taken), T.DoubleType()) for n in ("xmin", "ymin", "xmax", "ymax")]]
    return T.StructType([T.StructField(own[0][0], own[0][1], False), *fields, *[T.StructField(n, t) for n, t in own[1:]]])


def header(path: str) -> dict:
    """Shape type and extent of a file, and its reference system: that of the .prj file, or a guess by the extent."""
    from ..functions import srs

    base = _bases(path)[0]
    with open(f"{base}.shp", "rb") as f:
        head = f.read(100)
    if len(head) < 100 or struct.unpack_from(">i", head)[0] != FILE_CODE:
        raise ValueError(f"{path} isn't a shapefile")
    code, *box = struct.unpack_from("<i4d", head, 32)
    text = open(f"{base}.prj", encoding="utf-8").read() if os.path.exists(f"{base}.prj") else srs.guess(tuple(box))
    return {"type": code, "extent": tuple(box), "srs": text}


@dataclass
class _Range(InputPartition):
    """Records of one file; before is the number of records of the files ahead of it."""

    base: str
    before: int
    first: int
    last: int


Bounds = tuple[float, float, float, float]


def _bases(path: str) -> list[str]:
    path = local(path)
    if os.path.isdir(path):
        return sorted(os.path.join(path, f)[:-4] for f in os.listdir(path) if f.lower().endswith(".shp"))
    return [os.path.splitext(path)[0]]


def _apart(a: Bounds, b: Bounds) -> bool:
    return a[2] < b[0] or a[0] > b[2] or a[3] < b[1] or a[1] > b[3]


def blocks_that_meet(base: str, n: int, box: Bounds) -> list[tuple[int, int]]:
    """Ranges of records whose blocks' boxes meet a box; all records where there is no side file."""
    if not os.path.exists(f"{base}.cbx"):
        return [(0, n)]
    with open(f"{base}.cbx", "rb") as f:
        data = f.read()
    out: list[tuple[int, int]] = []
    for k in range(len(data) // 32):
        own = struct.unpack_from("<4d", data, 32 * k)
        if not _apart(own, box):
            first, last = BLOCK * k, min(n, BLOCK * (k + 1))
            out = [*out[:-1], (out[-1][0], last)] if out and out[-1][1] == first else [*out, (first, last)]
    return out


class _Reader(DataSourceReader):
    def __init__(self, path: str, options: dict) -> None:
        self.bases = _bases(path)
        self.box = tuple(float(v) for v in options["box"].split(",")) if options.get("box") else None
        self.charset = options.get("charset", "utf-8")
        self.size = int(options.get("records", RECORDS))

    def partitions(self) -> list[_Range]:
        out, before = [], 0
        for base in self.bases:
            n = (os.path.getsize(f"{base}.shx") - 100) // 8
            for low, high in blocks_that_meet(base, n, self.box) if self.box else [(0, n)]:
                out += [_Range(base, before, k, min(high, k + self.size)) for k in range(low, high, self.size)]
            before += n
        return out or [_Range(self.bases[0] if self.bases else "", 0, 0, 0)]

    def read(self, part: _Range) -> Iterator[tuple]:
        if part.first == part.last:
            return
        with open(f"{part.base}.shx", "rb") as f:
            f.seek(100 + 8 * part.first)
            index = list(struct.iter_unpack(">2i", f.read(8 * (part.last - part.first))))
        has = os.path.exists(f"{part.base}.dbf")
        _, start, width, columns = _dbf(f"{part.base}.dbf") if has else (0, 0, 0, [])
        with contextlib.ExitStack() as stack:
            table = stack.enter_context(open(f"{part.base}.dbf", "rb")) if has else None
            shapes = stack.enter_context(open(f"{part.base}.shp", "rb"))
            for i, (at, size) in enumerate(index, part.first):
                shapes.seek(2 * at + 8)
                head = shapes.read(min(36, 2 * size))
                if self.box and self._beyond(head):
                    continue
                raw = b""
                if table:
                    table.seek(start + width * i)
                    raw = table.read(width)
                    if raw[:1] == b"*":
                        continue
                g = decode(head + shapes.read(2 * size - len(head)))
                box = g and g["bbox"]
                flat = [box[k] for k in ("xMin", "yMin", "xMax", "yMax")] if box else [None] * 4
                shape = None if g is None else tuple(tuple(v.values()) if k == "bbox" else [tuple(p.values()) for p in v] if k == "points" else v for k, v in self._ordered(g).items())
                yield (part.before + i, *[c.value(raw, self.charset) for c in columns], shape, *flat)

    def _beyond(self, head: bytes) -> bool:
        """Whether a record's first bytes say that it is beyond the box, or has no shape."""
        (code,) = struct.unpack_from("<i", head)
        if code == 0:
            return True
        if code in _POINTS:
            x, y = struct.unpack_from("<2d", head, 4)
            return _apart((x, y, x, y), self.box)
        return _apart(struct.unpack_from("<4d", head, 4), self.box)

    @staticmethod
    def _ordered(g: dict) -> dict:
        box = g["bbox"]
        return g | {"bbox": {"type": box["type"]} | {k: box[k] for k in _zeros()}}


@dataclass
class _Written(WriterCommitMessage):
    path: str
    rows: int


class _Writer(DataSourceWriter):
    """Tasks write whole shapefiles to a folder, which the commit only renames; for one shapefile they write parts, which the commit puts together."""

    def __init__(self, path: str, schema: T.StructType, options: dict) -> None:
        path = local(path)
        self.single = path.lower().endswith(".shp")
        self.base, self.schema, self.options = os.path.splitext(path)[0] if self.single else path, schema, options
        self.charset = options.get("charset", "utf-8")
        self.shape = next((f.name for f in schema if f.dataType.simpleString() == GEOMETRY.simpleString()), None)
        if not self.shape:
            raise ValueError("a shapefile needs a geometry column")
        self.columns = [self._column(f) for f in schema if f.name != self.shape and f.name not in ("oid", "xmin", "ymin", "xmax", "ymax")]

    @staticmethod
    def _column(f: T.StructField) -> tuple[str, str, int, int]:
        meta = f.metadata or {}
        kind, size, scale = {T.IntegerType: ("N", 9, 0), T.ShortType: ("N", 6, 0), T.ByteType: ("N", 4, 0), T.LongType: ("N", 19, 0), T.DoubleType: ("F", 24, 11), T.FloatType: ("F", 19, 7), T.DateType: ("D", 8, 0), T.BooleanType: ("L", 1, 0), T.StringType: ("C", 254, 0)}.get(type(f.dataType), (None, 0, 0))
        if not kind:
            raise ValueError(f"a shapefile can't hold {f.dataType.simpleString()} {f.name}")
        return f.name, kind, meta.get("length") or size, meta.get("scale") or scale

    def _text(self, value: object, kind: str, size: int, scale: int) -> bytes:
        if value is None:
            return b" " * size
        if kind in "NF":
            out = (f"{value:.{scale}f}" if scale else str(int(value))).rjust(size)
            if len(out) > size:
                out = f"{value:.{max(0, size - 8)}e}".rjust(size)
            return out.encode()[:size]
        if kind == "D":
            return value.strftime("%Y%m%d").encode()
        if kind == "L":
            return b"T" if value else b"F"
        out = str(value).encode(self.charset)[:size]
        return out.decode(self.charset, "ignore").encode(self.charset).ljust(size)

    def _records(self, rows: Iterator[Row]) -> Iterator[tuple]:
        for row in rows:
            g = row[self.shape]
            flat = [(p["x"], p["y"]) for p in g["points"]] if g else []
            box = (min(x for x, _ in flat), min(y for _, y in flat), max(x for x, _ in flat), max(y for _, y in flat)) if flat else None
            yield encode(g), g["type"] if g else 0, box, b" " + b"".join(self._text(row[c], k, s, d) for c, k, s, d in self.columns)

    def write(self, rows: Iterator[Row]) -> _Written:
        name = uuid.uuid4().hex
        if self.single:
            path, n = f"{self.base}.part-{name}", 0
            os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
            with open(path, "wb") as f:
                for record in self._records(rows):
                    pickle.dump(record, f)
                    n += 1
            return _Written(path, n)
        os.makedirs(self.base, exist_ok=True)
        base = os.path.join(self.base, f"part-{name}")
        n = self._assemble(f"{base}.tmp", self._records(rows))
        return _Written(base, n)

    def _assemble(self, base: str, records: Iterator[tuple]) -> int:
        """Write a whole shapefile of records as they come; returns how many."""
        code, box, n, place = 0, None, 0, 50
        own_boxes: list[Bounds | None] = []
        around = lambda a, b: b if a is None else a if b is None else (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
        with open(f"{base}.shp", "wb") as shp, open(f"{base}.shx", "wb") as shx, open(f"{base}.dbf", "wb") as dbf:
            shp.write(b"\0" * 100)
            shx.write(b"\0" * 100)
            width = 1 + sum(s for _, _, s, _ in self.columns)
            start = 33 + 32 * len(self.columns)
            dbf.write(b"\0" * 32)
            for name, kind, size, scale in self.columns:
                dbf.write(struct.pack("<11sc4xBB14x", name.encode("latin-1", "replace")[:10], kind.encode(), size, scale))
            dbf.write(b"\r")
            for body, kind, own, record in records:
                code = code or kind
                if n % BLOCK == 0:
                    own_boxes.append(None)
                own_boxes[-1] = around(own_boxes[-1], own)
                n += 1
                shp.write(struct.pack(">2i", n, len(body) // 2) + body)
                shx.write(struct.pack(">2i", place, len(body) // 2))
                dbf.write(record)
                place += 4 + len(body) // 2
            dbf.write(b"\x1a")
            for b in own_boxes:
                box = around(box, b)
            for f, size in ((shp, place), (shx, 50 + 4 * n)):
                f.seek(0)
                f.write(struct.pack(">i20xi", FILE_CODE, size) + struct.pack("<2i8d", VERSION, code, *(box or (0.0,) * 4), 0.0, 0.0, 0.0, 0.0))
            dbf.seek(0)
            dbf.write(struct.pack("<4BIHH20x", 3, 126, 1, 1, n, start, width))
        with open(f"{base}.cbx", "wb") as f:
            f.write(b"".join(struct.pack("<4d", *(b or (math.inf, math.inf, -math.inf, -math.inf))) for b in own_boxes))
        if self.options.get("srs"):
            with open(f"{base}.prj", "w", encoding="utf-8") as f:
                f.write(self.options["srs"])
        return n

    def commit(self, messages: list[_Written | None]) -> None:
        done = [m for m in messages if m]
        if self.single:
            self._assemble(self.base, self._unpickled(done))
            self._clean(messages)
            return
        for m in done:  # names only: the tasks have written the files
            for end in ("shx", "dbf", "cbx", "prj", "shp"):
                if os.path.exists(f"{m.path}.tmp.{end}"):
                    os.rename(f"{m.path}.tmp.{end}", f"{m.path}.{end}")

    @staticmethod
    def _unpickled(done: list[_Written]) -> Iterator[tuple]:
        for m in done:
            with open(m.path, "rb") as f:
                for _ in range(m.rows):
                    yield pickle.load(f)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clean(messages)

    def _clean(self, messages: list[_Written | None]) -> None:
        for m in messages:
            for path in [m.path] if m and self.single else [f"{m.path}.tmp.{end}" for end in ("shp", "shx", "dbf", "cbx", "prj")] if m else []:
                if os.path.exists(path):
                    os.remove(path)


class ShapefileSource(DataSource):
    """Options: path; box as xmin,ymin,xmax,ymax; charset; records of a task; srs, written as .prj."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> T.StructType:
        return schema_of(self.options["path"])

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options["path"], self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShapefileSource)
