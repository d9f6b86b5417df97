"""Tables, fields and the enumerations of the data model."""

from __future__ import annotations

import enum
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

# Fixed values of the data model.


class WorkspaceType(enum.IntEnum):
    UNDEFINED, SHAPEFILE, SQLITE, ORACLE, MSSQL, POSTGIS, RASTER = range(7)


class DatasetType(enum.IntFlag):
    UNDEFINED, TABLE, SPATIAL_TABLE, GROUP, RASTER, ANY = 0, 1, 2, 4, 8, 15


class DataType(enum.IntEnum):
    UNKNOWN, NULL, INT8, INT16, INT32, INT64, UINT8, UINT16, UINT32, UINT64, FLOAT, DOUBLE, STRING, BLOB, DATE, GUID, GEOMETRY = range(17)


class SpatialRel(enum.IntEnum):
    UNDEFINED, INTERSECTS, TOUCHES, OVERLAPS, CROSSES, WITHIN, CONTAINS, RELATION = range(8)


class JoinType(enum.Enum):
    INNER, LEFT, RIGHT, OUTER = "inner", "left", "right", "full"


class JoinOp(enum.Enum):
    EQ, NE, LT, LE, GT, GE = "=", "!=", "<", "<=", ">", ">="


class TransactionType(enum.IntFlag):
    UNDEFINED, SELECT, MODIFY, DDL = 1, 2, 4, 8


#: Unsigned integers take the next wider signed type; 64-bit ones are decimals.
SPARK_TYPES: dict[DataType, T.DataType] = {
    DataType.NULL: T.NullType(), DataType.INT8: T.ByteType(), DataType.INT16: T.ShortType(), DataType.INT32: T.IntegerType(), DataType.INT64: T.LongType(),
    DataType.UINT8: T.ShortType(), DataType.UINT16: T.IntegerType(), DataType.UINT32: T.LongType(), DataType.UINT64: T.DecimalType(20, 0),
    DataType.FLOAT: T.FloatType(), DataType.DOUBLE: T.DoubleType(), DataType.STRING: T.StringType(), DataType.BLOB: T.BinaryType(), DataType.DATE: T.DateType(), DataType.GUID: T.StringType(),
}

_RANGES = [f"{axis}{end}" for axis in "xyzm" for end in ("Min", "Max")]
BBOX = T.StructType([T.StructField("type", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in _RANGES]])
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
GEOMETRY = T.StructType([
    T.StructField("type", T.IntegerType()), T.StructField("bbox", BBOX), T.StructField("parts", T.ArrayType(T.IntegerType())), T.StructField("part_types", T.ArrayType(T.IntegerType())),
    T.StructField("points", T.ArrayType(POINT)), T.StructField("zs", T.ArrayType(T.DoubleType())), T.StructField("ms", T.ArrayType(T.DoubleType())),
])
SPARK_TYPES[DataType.GEOMETRY] = GEOMETRY


@dataclass(frozen=True)
class GeometryDef:
    """What a spatial field holds: geometry type, Z and M, reference system and extent (xmin, ymin, xmax, ymax)."""

    shape_type: int = 0
    has_z: bool = False
    has_m: bool = False
    srs: str | None = None
    extent: tuple[float, float, float, float] | None = None


@dataclass(frozen=True)
class Field:
    name: str
    type: DataType = DataType.STRING
    alias: str = ""
    nullable: bool = True
    editable: bool = True
    required: bool = False
    primary_key: bool = False
    length: int = 0
    precision: int = 0
    scale: int = 0
    default: Any = None
    geometry: GeometryDef | None = None

    def struct(self) -> T.StructField:
        meta = {"alias": self.alias or self.name, "editable": self.editable, "required": self.required, "pk": self.primary_key, "length": self.length, "precision": self.precision, "scale": self.scale, "type": self.type.name}
        if self.default is not None:
            meta["default"] = str(self.default)
        if self.geometry:
            meta["geometry"] = str(self.geometry)
        return T.StructField(self.name, SPARK_TYPES[self.type], self.nullable and not self.primary_key, meta)

    @staticmethod
    def of(f: T.StructField) -> Field:
        """The field of a Spark column; its metadata says what Spark's type doesn't."""
        meta = f.metadata or {}
        kind = DataType[meta["type"]] if "type" in meta else next((k for k, t in SPARK_TYPES.items() if t == f.dataType), DataType.UNKNOWN)
        return Field(f.name, kind, meta.get("alias", ""), f.nullable, meta.get("editable", True), meta.get("required", False), meta.get("pk", False), meta.get("length", 0), meta.get("precision", 0), meta.get("scale", 0), meta.get("default"))

    def clone(self, **changes: Any) -> Field:
        """A copy, default value included."""
        return replace(self, **changes)


class Fields(list[Field]):
    """An ordered schema. Names are looked up exactly, then by what follows their first dot; the first of equal names wins."""

    def find(self, name: str) -> int:
        for wanted in (name, name.partition(".")[2]):
            for i, f in enumerate(self):
                if wanted and f.name == wanted:
                    return i
        return -1

    def schema(self) -> T.StructType:
        return T.StructType([f.struct() for f in self])

    @staticmethod
    def of(schema: T.StructType) -> Fields:
        return Fields(Field.of(f) for f in schema)


class FieldSet(list[str]):
    """An ordered projection list in which a name occurs once."""

    def __init__(self, names: list[str] | tuple[str, ...] = ()) -> None:
        super().__init__(dict.fromkeys(names))

    def add(self, name: str) -> bool:
        if name in self:
            return False
        self.append(name)
        return True


@dataclass(frozen=True)
class TableMeta:
    """What a table is besides its rows: id and shape columns, geometry, and where its bounding boxes stand."""

    name: str
    oid: str = "oid"
    kind: DatasetType = DatasetType.TABLE
    shape: str | None = None
    geometry: GeometryDef | None = None
    box: tuple[str, str, str, str] = ("xmin", "ymin", "xmax", "ymax")
    fields: Fields = field(default_factory=Fields)
