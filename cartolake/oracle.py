"""SQL of the queries, as DuckDB takes it."""

from __future__ import annotations

_PART = "SELECT p_partkey AS oid, p_brand AS name, p_retailprice AS x, CAST(p_size AS DOUBLE) AS y, p_retailprice AS xmin, p_retailprice AS xmax, CAST(p_size AS DOUBLE) AS ymin, CAST(p_size AS DOUBLE) AS ymax FROM part"
_SUPPLIER = "SELECT s_suppkey AS oid, s_name AS name, s_nationkey AS nation_id, s_acctbal - 500.0::DOUBLE AS xmin, s_acctbal + 500.0::DOUBLE AS xmax, CAST(s_nationkey AS DOUBLE) - 2.0::DOUBLE AS ymin, CAST(s_nationkey AS DOUBLE) + 2.0::DOUBLE AS ymax FROM supplier"
_ORDER = "SELECT l_orderkey AS oid, count(*) AS n_points, min(l_extendedprice) AS xmin, max(l_extendedprice) AS xmax, min(l_quantity) AS ymin, max(l_quantity) AS ymax FROM lineitem GROUP BY l_orderkey"
_POINTS = "SELECT l_orderkey AS oid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS seq, l_extendedprice AS x, l_quantity AS y FROM lineitem"
_LAYERS = f"geo_part AS ({_PART}), geo_supplier AS ({_SUPPLIER}), geo_order AS ({_ORDER}), geo_order_pt AS ({_POINTS})"


def _geo(sql: str, more: str = "") -> str:
    return f"WITH {_LAYERS}{more} {sql}"


_PAIRS = """, boxed AS (SELECT oid, CASE WHEN oid % 11 = 0 THEN 0 WHEN oid % 13 = 0 THEN 1 WHEN oid % 17 = 0 THEN -1 ELSE 2 END AS tag, xmin, xmax, ymin, ymax FROM geo_supplier),
pairs AS (SELECT l.oid AS a_oid, r.oid AS b_oid, l.tag AS ta, r.tag AS tb, l.xmin AS ax0, l.xmax AS ax1, l.ymin AS ay0, l.ymax AS ay1, r.xmin AS bx0, r.xmax AS bx1, r.ymin AS by0, r.ymax AS by1 FROM boxed l JOIN boxed r ON r.oid - l.oid IN (0, 1, 2, 11, 13, 17))"""
_SEGMENTS = ", segments AS (SELECT oid, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM geo_order_pt WINDOW w AS (PARTITION BY oid ORDER BY seq))"
_TYPES = "0, 1, 21, 11, 9, 8, 28, 18, 20, 3, 23, 13, 10, 5, 25, 15, 19, 31, 32, 50, 51, 52, 53, 54"

ORACLE: dict[str, str] = {
    "s_full_scan": "SELECT * FROM nation",
    "s_raw_sql": "SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name HAVING count(*) > 1",
    "s_raw_window": "SELECT c_custkey, c_nationkey, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS place, sum(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS pair FROM customer",
    "s_raw_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "s_raw_sets": "(SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 UNION SELECT s_nationkey FROM supplier) EXCEPT (SELECT n_nationkey FROM nation WHERE n_regionkey = 1 INTERSECT SELECT n_nationkey FROM nation)",
    "s_point_layer": _PART,
    "p_project_fields": "SELECT c_name, c_custkey FROM customer",
    "p_project_all_alias": "SELECT tableI.* FROM nation AS tableI",
    "p_duplicate_names": "SELECT a.n_nationkey, a.n_name, b.n_nationkey AS b_n_nationkey, b.n_name AS b_n_name FROM nation a JOIN nation b ON b.n_regionkey = a.n_regionkey",
    "p_null_test": "SELECT n_nationkey, NULL::VARCHAR AS next_name FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey + 3 FROM nation)",
    "f_where": "SELECT * FROM customer WHERE c_acctbal >= 5000 AND c_mktsegment = 'BUILDING'",
    "f_bbox_intersects": _geo("SELECT oid, name FROM geo_supplier WHERE xmax >= 0 AND xmin <= 3000 AND ymax >= 5 AND ymin <= 12"),
    "f_bbox_within": _geo("SELECT oid, x, y FROM geo_part WHERE xmin >= 910 AND xmax <= 950 AND ymin >= 10 AND ymax <= 30"),
    "f_bbox_touches": _geo("SELECT oid FROM geo_order WHERE xmin >= 0 AND xmax <= 30000 AND ymin >= 1 AND ymax <= 40"),
    "f_relation_undefined": _geo("SELECT oid FROM geo_supplier"),
    "f_bbox_and_where": _geo("SELECT oid, name FROM geo_part WHERE x BETWEEN 910 AND 950 AND y BETWEEN 10 AND 30 AND (name LIKE 'Brand#1%' OR y < 12)"),
    "f_oid_membership": _geo("SELECT oid, name FROM geo_supplier WHERE oid IN (SELECT oid FROM geo_part WHERE y = 7)"),
    "j_star_two": _geo("SELECT o_orderkey, o_totalprice, c_name, c_nationkey, n_points, xmin, xmax FROM orders JOIN customer ON c_custkey = o_custkey JOIN geo_order ON oid = o_orderkey WHERE o_orderkey <> 5"),
    "j_spatial_attr": _geo("SELECT oid, n_points, o_totalprice FROM geo_order JOIN orders ON o_orderkey = oid WHERE xmin >= 1000 AND xmax <= 60000 AND ymin >= 5 AND ymax <= 45 AND o_orderstatus = 'O'"),
    "j_no_join_fields": "SELECT s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 2",
    "j_boxes_meet": _geo("SELECT a.oid AS a_oid, b.oid AS b_oid FROM geo_supplier a JOIN geo_supplier b ON a.oid < b.oid AND a.xmax >= b.xmin AND a.xmin <= b.xmax AND a.ymax >= b.ymin AND a.ymin <= b.ymax"),
    "a_shape_bbox": _geo("SELECT oid, xmin, xmax, ymin, ymax FROM geo_order"),
    "a_layer_extent": _geo("SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM geo_order"),
    "a_map_extent": _geo("SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM (SELECT xmin, ymin, xmax, ymax FROM geo_part UNION ALL SELECT xmin, ymin, xmax, ymax FROM geo_supplier UNION ALL SELECT xmin, ymin, xmax, ymax FROM geo_order)"),
    "a_counts": _geo("SELECT layer_id, count(*) AS n, min(oid) AS first FROM (SELECT 1 AS layer_id, oid FROM geo_part WHERE xmax >= 0 AND xmin <= 5000 AND ymax >= 0 AND ymin <= 25 UNION ALL SELECT 2, oid FROM geo_supplier WHERE xmax >= 0 AND xmin <= 5000 AND ymax >= 0 AND ymin <= 25 UNION ALL SELECT 3, oid FROM geo_order WHERE xmax >= 0 AND xmin <= 5000 AND ymax >= 0 AND ymin <= 25) GROUP BY layer_id"),
    "a_summary": _geo("SELECT name, count(*) AS n, min(x) AS least, max(x) AS most, round(avg(y), 6) AS mean, count(DISTINCT y) AS kinds FROM geo_part GROUP BY name"),
    "u_select_features": _geo("SELECT 1 AS layer_id, oid FROM geo_part WHERE xmax >= 910 AND xmin <= 950 AND ymax >= 10 AND ymin <= 30 UNION ALL SELECT 2, oid FROM geo_supplier WHERE xmax >= 910 AND xmin <= 950 AND ymax >= 10 AND ymin <= 30 UNION ALL SELECT 3, oid FROM geo_order WHERE xmax >= 910 AND xmin <= 950 AND ymax >= 10 AND ymin <= 30"),
    "u_oid_union": _geo("SELECT oid FROM geo_part WHERE y < 10 UNION SELECT oid FROM geo_supplier"),
    "u_oid_except": _geo("SELECT oid FROM geo_part WHERE y < 10 EXCEPT SELECT oid FROM geo_supplier"),
    "u_oid_intersect": _geo("SELECT oid FROM geo_part WHERE y < 30 INTERSECT SELECT oid FROM geo_supplier"),
    "o_bbox_order": _geo("SELECT oid, nation_id, CAST(row_number() OVER (PARTITION BY nation_id ORDER BY xmin, ymin, xmax, ymax, oid) AS INTEGER) AS place FROM geo_supplier"),
    "o_top_k": _geo("SELECT oid, x FROM geo_part ORDER BY x DESC, oid LIMIT 20"),
    "o_variant_order": "WITH e AS (SELECT event_id, user_id, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END AS kind, event_type, value FROM events) SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY kind, CASE WHEN kind = 1 THEN user_id END, CASE WHEN kind = 2 THEN value END, CASE WHEN kind = 3 THEN event_type END, event_id) AS INTEGER) AS place FROM e",
    "b_predicates": _geo(
        """SELECT a_oid, b_oid, CAST(eq AS INTEGER) AS eq, CAST(NOT eq AS INTEGER) AS ne,
        CASE WHEN ta = -1 OR tb = -1 THEN 0 WHEN tb = 0 THEN 1 WHEN ta = 0 THEN 0 WHEN ta = 1 THEN 1 WHEN tb = 1 THEN 0 ELSE CAST(ax0 <= bx0 AND bx1 <= ax1 AND ay0 <= by0 AND by1 <= ay1 AS INTEGER) END AS holds,
        CASE WHEN ta IN (-1, 0) OR tb IN (-1, 0) THEN 0 WHEN ta = 1 OR tb = 1 THEN 1 ELSE CAST(ax1 >= bx0 AND ax0 <= bx1 AND ay1 >= by0 AND ay0 <= by1 AS INTEGER) END AS meets,
        CAST(ax0 < bx0 OR (ax0 = bx0 AND (ay0 < by0 OR (ay0 = by0 AND (ax1 < bx1 OR (ax1 = bx1 AND ay1 < by1))))) AS INTEGER) AS less
        FROM (SELECT *, CASE WHEN ta = -1 OR ta <> tb THEN FALSE WHEN ta IN (0, 1) THEN TRUE ELSE ax0 = bx0 AND ax1 = bx1 AND ay0 = by0 AND ay1 = by1 END AS eq FROM pairs)""",
        _PAIRS,
    ),
    "b_expand": _geo(
        """SELECT a_oid, b_oid, CASE pick WHEN 'a' THEN ta WHEN 'b' THEN tb ELSE 2 END AS tag,
        CASE pick WHEN 'a' THEN ax0 WHEN 'b' THEN bx0 ELSE least(ax0, bx0) END AS xmin, CASE pick WHEN 'a' THEN ax1 WHEN 'b' THEN bx1 ELSE greatest(ax1, bx1) END AS xmax,
        CASE pick WHEN 'a' THEN ay0 WHEN 'b' THEN by0 ELSE least(ay0, by0) END AS ymin, CASE pick WHEN 'a' THEN ay1 WHEN 'b' THEN by1 ELSE greatest(ay1, by1) END AS ymax
        FROM (SELECT *, CASE WHEN tb IN (-1, 0) THEN 'a' WHEN ta IN (-1, 0) THEN 'b' WHEN ta = 1 THEN 'a' WHEN tb = 1 THEN 'b' ELSE 'c' END AS pick FROM pairs)""",
        _PAIRS,
    ),
    "b_rects": _geo(
        """SELECT oid, CAST(meets AS INTEGER) AS meets, CASE WHEN meets THEN greatest(xmin, 0.0) END AS cut_xmin, CASE WHEN meets THEN least(ymax, 12.0) END AS cut_ymax, ymin - 2.0 AS wide_ymin, (xmin + xmax) / 2 AS cx,
        CAST(xmin >= 0 AND xmax <= 3000 AND ymin >= 5 AND ymax <= 12 AS INTEGER) AS inside, CAST(xmin <= 500 AND xmax >= 500 AND ymin <= 7 AND ymax >= 7 AS INTEGER) AS holds
        FROM (SELECT *, xmin < 3000 AND 0 < xmax AND ymin < 12 AND 5 < ymax AS meets FROM geo_supplier)"""
    ),
    "g_point_count": _geo("SELECT oid, CAST(n_points AS INTEGER) AS n_points, 1 AS n_parts FROM geo_order"),
    "g_part_points": _geo("SELECT o.oid, 2 AS first, CAST(n_points - 2 AS INTEGER) AS second, x AS x2, y AS y2 FROM geo_order o JOIN geo_order_pt p ON p.oid = o.oid AND seq = 3"),
    "g_clockwise": _geo("SELECT oid, round(coalesce(sum((y2 + y) * (x2 - x)), 0), 2) AS turn FROM segments GROUP BY oid", _SEGMENTS),
    "g_length": _geo("SELECT oid, round(coalesce(sum(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))), 0), 3) AS length FROM segments GROUP BY oid", _SEGMENTS),
    "g_types": f"""SELECT n_nationkey, code, CASE WHEN code IN (1, 21, 11, 9, 52) THEN 52 WHEN code IN (8, 28, 18, 20, 53) THEN 53 WHEN code IN (3, 23, 13, 10, 50) THEN 50 WHEN code IN (5, 25, 15, 19, 51) THEN 51 WHEN code IN (31, 32, 54) THEN 54 ELSE 0 END AS general,
        CAST(code IN (11, 9, 18, 20, 13, 10, 15, 19) AS INTEGER) AS z, CAST(code IN (21, 11, 28, 18, 23, 13, 25, 15, 31) AS INTEGER) AS m FROM (SELECT n_nationkey, [{_TYPES}][n_nationkey % 24 + 1] AS code FROM nation)""",
    "g_blob_round_trip": _geo("SELECT oid, CAST(n_points AS INTEGER) AS n_points, xmin, ymax FROM geo_order"),
    "c_mercator": _geo("SELECT oid, round((x - 900) * (pi() / 180 * 6378137.0), 3) AS mx, round(ln(tan(y * (pi() / 180) * 0.5 + pi() / 4)) * 6378137.0, 3) AS my FROM geo_part"),
    "c_round_trip": _geo("SELECT oid, round(x - 900, 7) AS x, round(y, 7) AS y FROM geo_part"),
    "x_strings": """SELECT p_partkey, CASE WHEN length(p_name) < 6 THEN '' ELSE substr(p_name, 1, 6) END AS head, CASE WHEN length(p_name) < 6 THEN '' ELSE substr(p_name, 7) END AS rest, substr(p_name, 3, 5) AS mid,
        lower(p_brand) AS low, to_base64(encode(p_name)) AS b64, p_name AS back, CASE WHEN upper(p_name) < upper(p_type) THEN -1 WHEN upper(p_name) > upper(p_type) THEN 1 ELSE 0 END AS cmp FROM part""",
    "x_paths": "SELECT p_partkey, 'file.' || p_size || '.tar' AS name, 'file.' || p_size AS bare, 'tar' AS ext, 'C:\\data/' || p_brand AS dir FROM part",
    "x_format": "SELECT n_nationkey, n_name || ' is ' || n_nationkey || ', {7} stays' AS text, lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS padded FROM nation",
    "x_numbers": "SELECT n_nationkey, CAST(n_nationkey AS BIGINT) AS whole, (CAST(n_nationkey AS DOUBLE) + 0.5) * 10 AS real, CASE WHEN n_nationkey % 2 = 1 THEN 1 ELSE 0 END AS odd FROM nation",
    "x_units_len": _geo("SELECT oid, round(x * 39.37::DOUBLE, 6) AS meters_inches, round(x * (63360::DOUBLE / 39.37::DOUBLE) / 1000.0, 6) AS miles_kilometers, round(x / 39.37::DOUBLE / 72 * 1000, 6) AS points_millimeters, round(x * (12::DOUBLE * 6080.27::DOUBLE) / 36, 6) AS nautical_miles_yards, round(x, 6) AS unknown_feet FROM geo_part"),
    "x_units_area": _geo("SELECT oid, round(x * (4046.8564224::DOUBLE / 1e4), 6) AS acres_hectares, round(x * (2589988.11::DOUBLE / 1e6), 6) AS square_miles_square_kilometers, round(x * 9.290304e-2, 6) AS square_feet_square_meters, CASE WHEN oid % 2 = 0 THEN 'square_miles' ELSE 'unknown' END AS unit FROM geo_part"),
    "x_haversine_m": _geo("SELECT oid, round(degrees(acos(greatest(-1, least(1, 0.5 * ((cos(radians(y) - radians(48)) + cos(radians(y) + radians(48))) * cos(radians(11) - radians(x - 950)) + (cos(radians(y) - radians(48)) - cos(radians(y) + radians(48)))))))) * 111194.8742964::DOUBLE, 2) AS meters FROM geo_part"),
    "x_dates": "SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%d%m%H%M%S') AS BIGINT) AS date_key, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS text, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS epoch FROM orders",
    "x_guids": "SELECT n_nationkey, '00000000-0000-4000-8000-' || lpad(CAST(n_nationkey AS VARCHAR), 12, 'a') AS guid, '{00000000-0000-0000-0000-000000000000}' AS none FROM nation",
    "m_map_to_device": _geo("SELECT oid, CAST(floor((x - 950) / (1000.0 * (1 / 39.37::DOUBLE) / 96) + 0.5) AS BIGINT) + 400 AS px, CAST(floor(-(y - 25) / (1000.0 * (1 / 39.37::DOUBLE) / 96) + 0.5) AS BIGINT) + 300 AS py FROM geo_part"),
    "m_device_to_map": "SELECT p_partkey, round((p_size - 400) * (1000.0 * (1 / 39.37::DOUBLE) / 96) + 950, 6) AS mx, round(-(p_size * 2 - 300) * (1000.0 * (1 / 39.37::DOUBLE) / 96) + 25, 6) AS my FROM part",
    "m_region_code": _geo("SELECT oid, CASE WHEN x < 910 THEN 1 ELSE 0 END + CASE WHEN x > 950 THEN 2 ELSE 0 END + CASE WHEN y < 10 THEN 8 ELSE 0 END + CASE WHEN y > 30 THEN 4 ELSE 0 END AS code FROM geo_part"),
    "m_scale_gate": "SELECT p_partkey, CAST((p_size % 5 = 0 OR 5000 >= p_size * 100) AND 5000 <= p_size * 400 AS INTEGER) AS shown FROM part",
    "m_symbols": _geo("SELECT oid, CASE name WHEN 'Brand#11' THEN 'star' WHEN 'Brand#12' THEN 'square' ELSE 'dot' END AS symbol FROM geo_part"),
    "m_layer_scan": _geo("SELECT oid, x, y FROM geo_part, (SELECT 1500.0::DOUBLE * (1 / 39.37::DOUBLE) / 96 AS r) WHERE y > 3 AND x BETWEEN 950 - 40 * r AND 950 + 40 * r AND y BETWEEN 25 - 30 * r AND 25 + 30 * r"),
    "f_out_srs": _geo("SELECT oid, round((x - 950) * (pi() / 180 * 6378137.0), 3) AS mx, round(ln(tan(y * (pi() / 180) * 0.5 + pi() / 4)) * 6378137.0, 3) AS my FROM geo_part WHERE (x - 950) * (pi() / 180 * 6378137.0) BETWEEN -3e6 AND 3e6 AND ln(tan(y * (pi() / 180) * 0.5 + pi() / 4)) * 6378137.0 BETWEEN 0 AND 3.5e6"),
    "g_area": _geo("SELECT oid, round((xmax - xmin) * (ymax - ymin), 3) AS area, round(2 * (xmax - xmin) + 2 * (ymax - ymin), 3) AS perimeter, 1 AS clockwise, 1 AS n_parts FROM geo_supplier"),
    "g_point_in_ring": _geo("SELECT oid, CAST(xmin < 1234.5678 AND xmax > 1234.5678 AND ymin < 7.25 AND ymax > 7.25 AS INTEGER) AS inside, round(xmin + 20000.0, 3) AS distance FROM geo_supplier"),
    "g_drop_repeats": _geo("SELECT oid, CAST(count(*) FILTER (WHERE b IS NULL OR a <> b) AS INTEGER) AS n_points FROM (SELECT oid, floor(x / 50000) AS a, lag(floor(x / 50000)) OVER (PARTITION BY oid ORDER BY seq) AS b FROM geo_order_pt) GROUP BY oid"),
    "m_clip_lines": _geo(
        """SELECT oid, round(coalesce(sum(CASE WHEN t0 <= t1 THEN (t1 - t0) * sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) END), 0), 3) AS inside, max(CASE WHEN t0 <= t1 THEN 1 ELSE 0 END) AS seen
        FROM (SELECT *, CASE WHEN (x2 = x AND (x < 10000 OR x > 60000)) OR (y2 = y AND (y < 10 OR y > 40)) THEN 2
            ELSE greatest(0, CASE WHEN x2 > x THEN (10000 - x) / (x2 - x) WHEN x2 < x THEN (60000 - x) / (x2 - x) END, CASE WHEN y2 > y THEN (10 - y) / (y2 - y) WHEN y2 < y THEN (40 - y) / (y2 - y) END) END AS t0,
            least(1, CASE WHEN x2 > x THEN (60000 - x) / (x2 - x) WHEN x2 < x THEN (10000 - x) / (x2 - x) END, CASE WHEN y2 > y THEN (40 - y) / (y2 - y) WHEN y2 < y THEN (10 - y) / (y2 - y) END) AS t1
            FROM segments WHERE x2 IS NOT NULL) GROUP BY oid""",
        _SEGMENTS,
    ),
    "s_shapefile": _geo("SELECT oid, name, xmin, ymax, 5 AS n_points FROM geo_supplier WHERE xmax >= 0 AND xmin <= 3000 AND ymax >= 5 AND ymin <= 12"),
    "s_sqlite": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation",
    "k_insert": "SELECT s_suppkey AS oid, s_name AS name, 'new' AS state, s_acctbal AS balance FROM supplier",
    "k_update": "SELECT s_suppkey AS oid, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE 'new' END AS state FROM supplier WHERE s_suppkey % 7 <> 0",
    "t_rollback": "SELECT s_suppkey AS oid FROM supplier",
    "k_delete_by_oid": _geo("SELECT oid, name FROM geo_supplier WHERE oid % 3 <> 0"),
    "k_etl_copy": _geo("SELECT oid, name, xmin, ymin, xmax, ymax FROM geo_supplier WHERE xmax >= 0 AND xmin <= 3000 AND ymax >= 5 AND ymin <= 12"),
}

_SIDES = "customer c {kind} JOIN (SELECT n_nationkey + 3 AS next_key, n_name AS next_name FROM nation) n ON n.next_key {op} c.c_nationkey"
for _name, _kind in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL OUTER")):
    for _op_name, _op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
        ORACLE[f"j_{_name}_{_op_name}"] = "SELECT c_custkey, c_nationkey, next_name, next_key FROM " + _SIDES.format(kind=_kind, op=_op)
