"""The queries of the reference's own operators over the driver's tables.

Points are parts by price and size, boxes are suppliers around balance and nation, lines are orders through their items' prices and quantities.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import bbox, dates, display, geometry, srs, strings, units
from .operators import oidset, spatial_join
from .operators.cartography import Layer, Map
from .operators.workspace import Workspace
from .plans.filters import Box, Join, QueryFilter
from .plans.model import DataType, Field, GeometryDef, JoinOp, JoinType, SpatialRel
from .sources import shapefile, sqlite

Query = Callable[[SparkSession, str], DataFrame]
#: By name; queries_more adds to it.
QUERIES: dict[str, Query] = {}

BOX = Box(910.0, 10.0, 950.0, 30.0)
SUPPLIER_BOX = Box(0.0, 5.0, 3000.0, 12.0)
VIEW = display.View(800, 600, 950.0, 25.0, 1000.0)


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geo_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("p_retailprice"), F.col("p_size").cast("double")
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("oid"), F.col("p_brand").alias("name"), x.alias("x"), y.alias("y"), x.alias("xmin"), x.alias("xmax"), y.alias("ymin"), y.alias("ymax"))


def geo_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("s_acctbal"), F.col("s_nationkey").cast("double")
    return _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("oid"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation_id"), (x - 500).alias("xmin"), (x + 500).alias("xmax"), (y - 2).alias("ymin"), (y + 2).alias("ymax"))


def geo_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = "l_extendedprice", "l_quantity"
    return _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("oid")).agg(F.count("*").alias("n_points"), F.min(x).alias("xmin"), F.max(x).alias("xmax"), F.min(y).alias("ymin"), F.max(y).alias("ymax"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """oid and points of orders; the sort keys settle every tie."""
    keys = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
    listed = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("oid")).agg(F.sort_array(F.collect_list(F.struct(*keys))).alias("all"))
    return listed.select("oid", F.transform("all", lambda p: F.struct(p["l_extendedprice"].alias("x"), p["l_quantity"].alias("y"))).alias("points"))


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    w = Workspace(spark, "driver")
    for name in ("region", "nation", "customer", "supplier", "orders", "part", "events"):
        w.add(name, _read(spark, sf_dir, name))
    for name, make in (("geo_part", geo_part), ("geo_supplier", geo_supplier), ("geo_order", geo_order)):
        w.add(name, make(spark, sf_dir))
    return w


# Scans and projections.


@_query
def s_full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir).table("nation").search()


@_query
def s_raw_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir).select("SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM nation JOIN customer ON c_nationkey == n_nationkey WHERE c_acctbal > 0 GROUP BY n_name HAVING count(*) > 1 ORDER BY n_name")


@_query
def s_raw_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir).select("SELECT c_custkey, c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place, sum(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS pair FROM customer")


@_query
def s_raw_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir).select("SELECT o_orderstatus, o_orderpriority, count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")


@_query
def s_raw_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir).select("(SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 UNION SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1 INTERSECT SELECT n_nationkey FROM nation")


@_query
def s_point_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo_part(spark, sf_dir)


@_query
def p_project_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir).table("customer").search(QueryFilter().with_fields("c_name", "c_custkey", "c_name"))


@_query
def p_project_all_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir).table("nation").search(QueryFilter().with_prefix("tableI"))


@_query
def p_duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = QueryFilter().with_prefix("a").with_fields("n_nationkey", "n_name").with_join(Join("nation", "n_regionkey", "n_regionkey", fields=("n_nationkey", "n_name"), prefix="b"))
    return workspace(spark, sf_dir).table("nation").search(q)


@_query
def p_null_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations without a partner among nations three further on."""
    w = workspace(spark, sf_dir)
    w.add("next_nation", next_nation(spark, sf_dir))
    q = QueryFilter().with_fields("n_nationkey").with_join(Join("next_nation", "next_key", "n_nationkey", JoinType.LEFT, fields=("next_name",))).with_where("next_name IS NULL")
    return w.table("nation").search(q)


# Filters.


@_query
def f_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir).table("customer").search(QueryFilter().with_prefix("t").with_where(" AND t.c_acctbal >= 5000 AND t.c_mktsegment == 'BUILDING'"))


@_query
def f_bbox_intersects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir).table("geo_supplier").search(QueryFilter().with_fields("oid", "name").with_box(SUPPLIER_BOX))


@_query
def f_bbox_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir).table("geo_part").search(QueryFilter().with_fields("oid", "x", "y").with_box(BOX, SpatialRel.WITHIN))


@_query
def f_bbox_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir).table("geo_order").search(QueryFilter().with_fields("oid").with_box(Box(0.0, 1.0, 30000.0, 40.0), SpatialRel.TOUCHES))


@_query
def f_relation_undefined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir).table("geo_supplier").search(QueryFilter().with_fields("oid").with_box(SUPPLIER_BOX, SpatialRel.UNDEFINED))


@_query
def f_bbox_and_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir).table("geo_part").search(QueryFilter().with_fields("oid", "name").with_box(BOX).with_where("geo_part.name LIKE 'Brand#1%' OR geo_part.y < 12"))


@_query
def f_oid_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workspace(spark, sf_dir)
    return w.table("geo_supplier").with_oids(oidset.of(geo_part(spark, sf_dir).where("y = 7"))).select("oid", "name")


# Joins.


def next_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nations under keys three further on, so that both sides of a join have rows without a partner."""
    return _read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 3).alias("next_key"), F.col("n_name").alias("next_name"))


def _join(kind: JoinType, op: JoinOp) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """All customers with all nations."""
        w = workspace(spark, sf_dir)
        w.add("next_nation", next_nation(spark, sf_dir))
        join = Join("next_nation", "next_key", "c_nationkey", kind, op, ("next_name", "next_key"))
        return w.table("customer").search(QueryFilter().with_fields("c_custkey", "c_nationkey").with_join(join))

    return run


for _kind in JoinType:
    for _op in JoinOp:
        QUERIES[f"j_{'full' if _kind is JoinType.OUTER else _kind.value}_{_op.name.lower()}"] = _join(_kind, _op)


@_query
def j_star_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = QueryFilter().with_prefix("o").with_fields("o_orderkey", "o_totalprice").with_where("o.o_orderkey != 5")
    q = q.with_join(Join("customer", "c_custkey", "o_custkey", fields=("c_name", "c_nationkey"), prefix="c")).with_join(Join("geo_order", "oid", "o_orderkey", fields=("n_points", "xmin", "xmax"), prefix="g"))
    return workspace(spark, sf_dir).table("orders").search(q)


@_query
def j_spatial_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = QueryFilter().with_fields("oid", "n_points").with_box(Box(1000.0, 5.0, 60000.0, 45.0), SpatialRel.WITHIN).with_where("o.o_orderstatus = 'O'").with_join(Join("orders", "o_orderkey", "oid", fields=("o_totalprice",), prefix="o"))
    return workspace(spark, sf_dir).table("geo_order").search(q)


@_query
def j_no_join_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir).table("supplier").search(QueryFilter().with_fields("s_suppkey").with_join(Join("nation", "n_nationkey", "s_nationkey")).with_where("nation.n_regionkey = 2"))


@_query
def j_boxes_meet(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = geo_supplier(spark, sf_dir)
    return spatial_join.join(s, s, 1000.0).where("a_oid < b_oid").select("a_oid", "b_oid")


# Aggregates, order and sets.


@_query
def a_shape_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = geometry.box_of(F.col("points"))
    return order_lines(spark, sf_dir).withColumn("b", box).select("oid", F.col("b.xMin").alias("xmin"), F.col("b.xMax").alias("xmax"), F.col("b.yMin").alias("ymin"), F.col("b.yMax").alias("ymax"))


@_query
def a_layer_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir).table("geo_order").extent()


def _map(spark: SparkSession, sf_dir: str) -> Map:
    w, m = workspace(spark, sf_dir), Map("driver")
    for i, name in enumerate(("geo_part", "geo_supplier", "geo_order"), 1):
        m.add(Layer(i, name, w.table(name)))
    return m


@_query
def a_map_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map's extent as one row."""
    return spark.createDataFrame([_map(spark, sf_dir).full_extent()], "xmin double, ymin double, xmax double, ymax double")


@_query
def a_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _map(spark, sf_dir).select_features(Box(0.0, 0.0, 5000.0, 25.0))
    return s.groupBy("layer_id").agg(F.count("*").alias("n"), F.min("oid").alias("first"))


@_query
def a_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo_part(spark, sf_dir).groupBy("name").agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.round(F.avg("y"), 6).alias("mean"), F.countDistinct("y").alias("kinds"))


@_query
def u_select_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map(spark, sf_dir).select_features(BOX)


@_query
def u_oid_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oidset.add(oidset.of(geo_part(spark, sf_dir).where("y < 10")), oidset.of(geo_supplier(spark, sf_dir)))


@_query
def u_oid_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oidset.remove(oidset.of(geo_part(spark, sf_dir).where("y < 10")), oidset.of(geo_supplier(spark, sf_dir)))


@_query
def u_oid_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oidset.intersect(oidset.of(geo_part(spark, sf_dir).where("y < 30")), oidset.of(geo_supplier(spark, sf_dir)))


@_query
def o_bbox_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = geo_supplier(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("nation_id").orderBy("xmin", "ymin", "xmax", "ymax", "oid"))
    return s.select("oid", "nation_id", place.alias("place"))


@_query
def o_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo_part(spark, sf_dir).orderBy(F.desc("x"), "oid").limit(20).select("oid", "x")


@_query
def o_variant_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 3 == 0, "bigint").when(F.col("event_id") % 3 == 1, "string").otherwise("double")
    key = strings.variant_order(kind, F.when(kind == "bigint", F.col("user_id")), F.when(kind == "double", F.col("value")), F.when(kind == "string", F.col("event_type")))
    return e.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(key, "event_id")).alias("place"))


# Boxes.


def _box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of suppliers with those of six others by key, themselves included; some of them are null, infinite or invalid."""
    s = geo_supplier(spark, sf_dir)
    tag = F.when(F.col("oid") % 11 == 0, bbox.NULL).when(F.col("oid") % 13 == 0, bbox.INFINITE).when(F.col("oid") % 17 == 0, bbox.INVALID).otherwise(bbox.NORMAL)
    boxed = s.select("oid", "nation_id", bbox.make(F.col("xmin"), F.col("xmax"), F.col("ymin"), F.col("ymax"), tag=tag).alias("b"))
    left = boxed.withColumn("other", F.explode(F.array(*[F.col("oid") + d for d in (0, 1, 2, 11, 13, 17)])))
    return left.alias("l").join(boxed.alias("r"), F.col("l.other") == F.col("r.oid")).select(F.col("l.oid").alias("a_oid"), F.col("r.oid").alias("b_oid"), F.col("l.b").alias("a"), F.col("r.b").alias("b"))


@_query
def b_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    as_int = lambda c, n: c.cast("int").alias(n)
    return _box_pairs(spark, sf_dir).select("a_oid", "b_oid", as_int(bbox.equal(a, b), "eq"), as_int(bbox.not_equal(a, b), "ne"), as_int(bbox.contains(a, b), "holds"), as_int(bbox.intersects(a, b), "meets"), as_int(bbox.less(a, b), "less"))


@_query
def b_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bbox.expand(F.col("a"), F.col("b"))
    return _box_pairs(spark, sf_dir).withColumn("e", e).select("a_oid", "b_oid", F.col("e.type").alias("tag"), F.col("e.xMin").alias("xmin"), F.col("e.xMax").alias("xmax"), F.col("e.yMin").alias("ymin"), F.col("e.yMax").alias("ymax"))


@_query
def b_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = bbox.rect(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))
    q = bbox.rect(*[F.lit(v) for v in (0.0, 5.0, 3000.0, 12.0)])
    cut, wide = bbox.rect_intersect(r, q), bbox.rect_inflate(r, 1.0, 2.0)
    return geo_supplier(spark, sf_dir).select("oid", bbox.rect_meets(r, q).cast("int").alias("meets"), cut["xmin"].alias("cut_xmin"), cut["ymax"].alias("cut_ymax"), wide["ymin"].alias("wide_ymin"), bbox.rect_center(r)["x"].alias("cx"), bbox.rect_inside(r, q).cast("int").alias("inside"), bbox.rect_holds_point(r, F.lit(500.0), F.lit(7.0), True).cast("int").alias("holds"))


# Geometry.


@_query
def g_point_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = geometry.make(geometry.TYPES["polyline"], F.col("points"))
    return order_lines(spark, sf_dir).withColumn("g", g).select("oid", geometry.point_count(F.col("g")).alias("n_points"), geometry.part_count(F.col("g")).alias("n_parts"))


@_query
def g_part_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of two parts, the second from the third point on."""
    g = geometry.make(geometry.TYPES["polyline"], F.col("points"), F.array(F.lit(0), F.lit(2)))
    rows = order_lines(spark, sf_dir).where(F.size("points") > 2).withColumn("g", g)
    sizes = geometry.part_sizes(F.col("g.parts"), geometry.point_count(F.col("g")))
    return rows.select("oid", F.get(sizes, F.lit(0)).alias("first"), F.get(sizes, F.lit(1)).alias("second"), geometry.point(F.col("g"), 2)["x"].alias("x2"), F.get(geometry.part_points(F.col("g"), 1), F.lit(0))["y"].alias("y2"))


@_query
def g_clockwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("points")
    return order_lines(spark, sf_dir).select("oid", F.round(geometry.turn(p), 2).alias("turn"))


@_query
def g_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_lines(spark, sf_dir).select("oid", F.round(geometry.length(F.col("points")), 3).alias("length"))


@_query
def g_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = list(geometry.TYPES.values())
    code = F.get(F.array(*map(F.lit, codes)), F.col("n_nationkey") % len(codes))
    rows = _read(spark, sf_dir, "nation").withColumn("code", code)
    c = F.col("code")
    return rows.select("n_nationkey", "code", geometry.general_type(c).alias("general"), geometry.has_z(c).cast("int").alias("z"), geometry.has_m(c).cast("int").alias("m"))


@_query
def g_blob_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry to its binary form and back."""
    g = geometry.make(geometry.TYPES["polyline"], F.col("points"))
    rows = order_lines(spark, sf_dir).withColumn("g", geometry.from_blob(geometry.to_blob(g)))
    return rows.select("oid", F.size("g.points").alias("n_points"), F.col("g.bbox.xMin").alias("xmin"), F.col("g.bbox.yMax").alias("ymax"))


# Reference systems.


@_query
def c_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    move = srs.transformer("EPSG:4326", "EPSG:3857")
    p = move(F.col("x") - 900, F.col("y"))
    return geo_part(spark, sf_dir).select("oid", F.round(p["x"], 3).alias("mx"), F.round(p["y"], 3).alias("my"))


@_query
def c_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    there, back = srs.transformer("EPSG:4326", "EPSG:3395"), srs.transformer("EPSG:3395", "EPSG:4326")
    rows = geo_part(spark, sf_dir).withColumn("m", there(F.col("x") - 900, F.col("y"))).withColumn("b", back(F.col("m.x"), F.col("m.y")))
    return rows.select("oid", F.round("b.x", 7).alias("x"), F.round("b.y", 7).alias("y"))


# Scalars.


@_query
def x_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_name")
    return _read(spark, sf_dir, "part").select("p_partkey", strings.left(s, 6).alias("head"), strings.suffix(s, 6).alias("rest"), strings.mid(s, 2, 5).alias("mid"), strings.lower_ascii(F.col("p_brand")).alias("low"), strings.to_base64(s).alias("b64"), strings.decode(strings.from_base64(strings.to_base64(s))).alias("back"), strings.compare(s, F.col("p_type"), True).alias("cmp"))


@_query
def x_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.concat(F.lit("C:\\data/"), F.col("p_brand"), F.lit("/file."), F.col("p_size").cast("string"), F.lit(".tar"))
    return _read(spark, sf_dir, "part").select("p_partkey", strings.file_name(p).alias("name"), strings.bare_name(p).alias("bare"), strings.extension(p).alias("ext"), strings.directory(p).alias("dir"))


@_query
def x_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation").select("n_nationkey", strings.format_positional("{1} is {0}, {7} stays", F.col("n_nationkey"), F.col("n_name")).alias("text"), strings.number_text(F.col("n_nationkey"), 5).alias("padded"))


@_query
def x_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(F.col("n_nationkey").cast("string"), F.lit(".5e1 apples"))
    return _read(spark, sf_dir, "nation").select("n_nationkey", strings.to_integer(s).alias("whole"), strings.to_double(s).alias("real"), strings.to_bool((F.col("n_nationkey") % 2).cast("string")).cast("int").alias("odd"))


@_query
def x_units_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("x")
    return geo_part(spark, sf_dir).select("oid", *[F.round(units.convert_length(v, a, b), 6).alias(f"{a}_{b}") for a, b in (("meters", "inches"), ("miles", "kilometers"), ("points", "millimeters"), ("nautical_miles", "yards"), ("unknown", "feet"))])


@_query
def x_units_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("x")
    return geo_part(spark, sf_dir).select("oid", *[F.round(units.convert_area(v, a, b), 6).alias(f"{a}_{b}") for a, b in (("acres", "hectares"), ("square_miles", "square_kilometers"), ("square_feet", "square_meters"))], units.area_unit(F.when(F.col("oid") % 2 == 0, "miles").otherwise("points")).alias("unit"))


@_query
def x_haversine_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = units.meters_distance(F.col("y"), F.col("x") - 950, F.lit(48.0), F.lit(11.0))
    return geo_part(spark, sf_dir).select("oid", F.round(d, 2).alias("meters"))


@_query
def x_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_timestamp("o_orderdate")
    return _read(spark, sf_dir, "orders").select("o_orderkey", dates.date_key(F.col("o_orderdate")).alias("date_key"), dates.format_epoch(seconds, "%Y-%m-%d %H:%M:%S").alias("text"), dates.parse_epoch(F.date_format("o_orderdate", "yyyyMMddHHmmss")).alias("epoch"))


@_query
def x_guids(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("{00000000-0000-4000-8000-"), F.lpad(F.col("n_nationkey").cast("string"), 12, "A"), F.lit("}"))
    return _read(spark, sf_dir, "nation").select("n_nationkey", strings.parse_guid(text).alias("guid"), strings.format_guid(strings.parse_guid(F.col("n_name"))).alias("none"))


# Display.


@_query
def m_map_to_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, py = display.to_device(VIEW, F.col("x"), F.col("y"))
    return geo_part(spark, sf_dir).select("oid", px.alias("px"), py.alias("py"))


@_query
def m_device_to_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    mx, my = display.to_map(VIEW, F.col("p_size"), F.col("p_size") * 2)
    return _read(spark, sf_dir, "part").select("p_partkey", F.round(mx, 6).alias("mx"), F.round(my, 6).alias("my"))


@_query
def m_region_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo_part(spark, sf_dir).select("oid", display.region_code(F.col("x"), F.col("y"), BOX.xmin, BOX.ymin, BOX.xmax, BOX.ymax).alias("code"))


@_query
def m_scale_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = display.scale_visible(5000.0, F.col("p_size") * 400.0, F.when(F.col("p_size") % 5 == 0, 0.0).otherwise(F.col("p_size") * 100.0))
    return _read(spark, sf_dir, "part").select("p_partkey", shown.cast("int").alias("shown"))


@_query
def m_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.cartography import Renderer

    r = Renderer(symbol="dot", by_field="name", symbols=(("Brand#11", "star"), ("Brand#12", "square")))
    return r.draw(geo_part(spark, sf_dir)).select("oid", "symbol")


@_query
def m_layer_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workspace(spark, sf_dir)
    layer = Layer(1, "parts", w.table("geo_part"), min_scale=100000.0, definition="y > 3")
    return layer.scan(display.View(80, 60, 950.0, 25.0, 1500.0), QueryFilter().with_fields("oid", "x", "y"))


# Shapes as a table's column.


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' boxes as polygons: oid, name and shape."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("xmin", "ymin"), corner("xmin", "ymax"), corner("xmax", "ymax"), corner("xmax", "ymin"), corner("xmin", "ymin"))
    return geo_supplier(spark, sf_dir).select("oid", "name", geometry.make(geometry.TYPES["polygon"], ring, F.array(F.lit(0))).alias("shape"))


@_query
def f_out_srs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search whose box and shapes are in other systems than the table's."""
    w = Workspace(spark, "srs")
    shapes = geo_part(spark, sf_dir).withColumn("x", F.col("x") - 950).drop("xmin", "xmax").withColumn("xmin", F.col("x")).withColumn("xmax", F.col("x"))
    shape = geometry.make(geometry.TYPES["point"], F.array(F.struct("x", "y")))
    w.add("parts_lonlat", shapes.withColumn("shape", shape), shape="shape", geometry=GeometryDef(1, srs="EPSG:4326"))
    q = QueryFilter().with_fields("oid", "shape").with_box(Box(-3e6, 0.0, 3e6, 3.5e6, "EPSG:3857")).with_out_srs("EPSG:3857")
    spark.catalog.dropTempView("parts_lonlat")
    found = w.table("parts_lonlat").search(q)
    return found.select("oid", F.round(geometry.point(F.col("shape"), 0)["x"], 3).alias("mx"), F.round(geometry.point(F.col("shape"), 0)["y"], 3).alias("my"))


@_query
def g_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("shape")
    return rings(spark, sf_dir).select("oid", F.round(geometry.shape_area(g), 3).alias("area"), F.round(geometry.perimeter(g["points"]), 3).alias("perimeter"), geometry.is_clockwise(g["points"]).cast("int").alias("clockwise"), geometry.part_count(g).alias("n_parts"))


@_query
def g_point_in_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("shape.points")
    return rings(spark, sf_dir).select("oid", geometry.point_in_ring(p, F.lit(1234.5678), F.lit(7.25)).cast("int").alias("inside"), F.round(geometry.distance_to_point(p, F.lit(-20000.0), F.col("shape.bbox.yMin") + 1), 3).alias("distance"))


@_query
def g_drop_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in whole thousands, those equal to their predecessor dropped."""
    coarse = F.transform("points", lambda p: F.struct(F.floor(p["x"] / 50000).cast("double").alias("x"), F.lit(0.0).alias("y")))
    return order_lines(spark, sf_dir).select("oid", F.size(geometry.drop_repeats(coarse)).alias("n_points"))


@_query
def m_clip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long orders' lines are inside a box, and in how many runs."""
    runs = display.clip_lines(F.array("points"), (10000.0, 10.0, 60000.0, 40.0))
    rows = order_lines(spark, sf_dir).where(F.size("points") > 1).withColumn("runs", runs)
    total = F.aggregate(F.transform("runs", geometry.length), F.lit(0.0), lambda a, x: a + x)
    return rows.select("oid", F.round(total, 3).alias("inside"), (F.size("runs") > 0).cast("int").alias("seen"))


# Sources and stored tables.


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder where all executors can write, removed when the driver's JVM ends: in spark.checkpoint.dir, or in /tmp on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{(shared or 'file:///tmp/checkpoints/cartolake').rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


@_query
def s_shapefile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as a folder of shapefiles, one a task, and searched by a box."""
    shapefile.register(spark)
    path = scratch(spark, "shapes")
    rings(spark, sf_dir).withColumnRenamed("oid", "key").write.format("shapefile").mode("append").option("path", path).save()
    found = spark.read.format("shapefile").option("box", f"{SUPPLIER_BOX.xmin},{SUPPLIER_BOX.ymin},{SUPPLIER_BOX.xmax},{SUPPLIER_BOX.ymax}").load(path)
    return found.select(F.col("key").alias("oid"), "name", "xmin", "ymax", geometry.point_count(F.col("shape")).alias("n_points"))


@_query
def s_sqlite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations put into a SQLite file and read from it."""
    sqlite.register(spark)
    path = shapefile.local(scratch(spark, "sqlite"))
    os.makedirs(path, exist_ok=True)
    with sqlite3.connect(f"{path}/nation.db") as db:
        db.execute("CREATE TABLE nation (n_nationkey INTEGER PRIMARY KEY, n_name TEXT NOT NULL, n_regionkey INTEGER)")
        db.executemany("INSERT INTO nation VALUES (?, ?, ?)", [tuple(r) for r in _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()])
    return spark.read.format("sqlite_file").options(path=f"{path}/nation.db", table="nation", rows=10).load()


def _stored(spark: SparkSession, sf_dir: str) -> Workspace:
    """A stored table of suppliers' names, states and balances."""
    w = Workspace(spark, "stored", scratch(spark, "workspace"))
    w.create_table("stored_supplier", [Field("oid", DataType.INT64, primary_key=True), Field("name", DataType.STRING, nullable=False), Field("state", DataType.STRING, default="'new'"), Field("balance", DataType.DOUBLE)])
    with w.transaction() as t:
        t.insert("stored_supplier", _read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS oid", "s_name AS name", "s_acctbal AS balance"))
    return w


@_query
def k_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).table("stored_supplier").search()


@_query
def k_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _stored(spark, sf_dir)
    with w.transaction() as t:
        t.update("stored_supplier", w.table("stored_supplier").df.where("balance < 0").select("oid", F.lit("debt").alias("state")))
        t.delete("stored_supplier", w.table("stored_supplier").df.where("oid % 7 = 0").select("oid"))
    return w.table("stored_supplier").search(QueryFilter().with_fields("oid", "state"))


@_query
def t_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _stored(spark, sf_dir)
    t = w.transaction()
    t.delete("stored_supplier", w.table("stored_supplier").df.select("oid"))
    t.rollback()
    return w.table("stored_supplier").search(QueryFilter().with_fields("oid"))


# The raw side of changes.


@_query
def k_delete_by_oid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oidset.rows_not_in(geo_supplier(spark, sf_dir), oidset.of(geo_supplier(spark, sf_dir).where("oid % 3 = 0"))).select("oid", "name")


@_query
def k_etl_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers searched in shapefiles by a box and copied into a stored spatial table, which is read back."""
    shapefile.register(spark)
    path = scratch(spark, "etl-shapes")
    rings(spark, sf_dir).withColumnRenamed("oid", "key").write.format("shapefile").mode("append").option("path", path).save()
    w = Workspace(spark, "etl", scratch(spark, "etl"))
    w.create_table("copied", [Field("oid", DataType.INT64, primary_key=True), Field("name"), Field("shape", DataType.GEOMETRY, geometry=GeometryDef(5))])
    found = spark.read.format("shapefile").option("box", f"{SUPPLIER_BOX.xmin},{SUPPLIER_BOX.ymin},{SUPPLIER_BOX.xmax},{SUPPLIER_BOX.ymax}").load(path)
    with w.transaction() as t:
        t.insert("copied", found.select(F.col("key").alias("oid"), "name", F.col("Shape").alias("shape")))
    return w.table("copied").search().select("oid", "name", "xmin", "ymin", "xmax", "ymax")
