"""SQL of the queries in queries_more.py, as DuckDB takes it."""

from __future__ import annotations

import zlib

from .oracle import _SEGMENTS, ORACLE, _geo

__all__ = ["ORACLE"]

_FOUR = ", pairs AS (SELECT l.oid AS a_oid, r.oid AS b_oid, l.xmin AS ax0, l.xmax AS ax1, l.ymin AS ay0, l.ymax AS ay1, r.xmin AS bx0, r.xmax AS bx1, r.ymin AS by0, r.ymax AS by1, greatest(0, least(l.xmax, r.xmax) - greatest(l.xmin, r.xmin)) * greatest(0, least(l.ymax, r.ymax) - greatest(l.ymin, r.ymin)) AS shared FROM geo_supplier l JOIN geo_supplier r ON r.oid - l.oid BETWEEN 0 AND 3)"
_LONLAT = ", lonlat AS (SELECT oid, (oid % 1000) / 100.0::DOUBLE + 5 AS lon, y * 0.4::DOUBLE + 40 AS lat FROM geo_part), placed AS (SELECT oid, lon, lat, radians(lon) AS l, radians(lat) AS p, 6371000.0::DOUBLE AS r FROM lonlat)"


def _system(x: str, y: str, before: str = "") -> str:
    return _geo(f"SELECT oid, round({x}, 3) AS mx, round({y}, 3) AS my, 1 AS again FROM placed{before}", _LONLAT)


_CONIC = "(SELECT ln(cos(radians(43)) / cos(radians(62))) / ln(tan(pi() / 4 - radians(43) / 2) / tan(pi() / 4 - radians(62) / 2)) AS n)"
_ALBERS = "(SELECT (sin(radians(43)) + sin(radians(62))) / 2 AS n)"
_L10, _L9 = "(l - radians(10))", "(l - radians(9))"
_COS_C = f"(sin(radians(52)) * sin(p) + cos(radians(52)) * cos(p) * cos({_L10}))"
_EAST, _NORTH = f"cos(p) * sin({_L10})", f"(cos(radians(52)) * sin(p) - sin(radians(52)) * cos(p) * cos({_L10}))"

ORACLE |= {
    "s_raw_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "s_raw_grouping_sets": "SELECT c_mktsegment, c_nationkey, count(*) AS n, count(DISTINCT c_custkey % 7) AS kinds FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "s_exists": "SELECT * FROM (VALUES ('nation', 1), ('geo_part', 1), ('no_such_table', 0)) AS v(name, there)",
    "p_metadata": "SELECT CAST(column_index AS INTEGER) AS place, column_name AS name, CASE data_type WHEN 'VARCHAR' THEN 'STRING' WHEN 'INTEGER' THEN 'INT32' WHEN 'BIGINT' THEN 'INT64' ELSE data_type END AS kind, CAST(column_index AS INTEGER) AS dotted FROM (SELECT row_number() OVER () - 1 AS column_index, column_name, column_type AS data_type FROM (DESCRIBE SELECT * FROM nation))",
    "f_shape_box": _geo("SELECT p.oid FROM geo_part p, (SELECT * FROM geo_supplier WHERE oid = 1) s WHERE p.xmin >= s.xmin - 5000 AND p.xmax <= s.xmax + 5000 AND p.ymin >= s.ymin AND p.ymax <= s.ymax"),
    "f_hook": _geo("SELECT oid, y, 'dot' AS symbol FROM geo_part, (SELECT 1500.0::DOUBLE * (1 / 39.37::DOUBLE) / 96 AS r) WHERE x BETWEEN 950 - 400 * r AND 950 + 400 * r AND y BETWEEN 25 - 300 * r AND 25 + 300 * r AND y % 2 = 0"),
    "f_tolerance": _geo("SELECT oid, CAST(least(n_points, 2) AS INTEGER) AS n_points FROM geo_order"),
    "j_semi": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "j_anti": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "j_as_of": "SELECT o.o_orderkey, (SELECT max(p.o_totalprice) FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderstatus = 'F' AND p.o_orderdate = (SELECT max(q.o_orderdate) FROM orders q WHERE q.o_custkey = o.o_custkey AND q.o_orderstatus = 'F' AND q.o_orderdate <= o.o_orderdate)) AS last_price FROM orders o",
    "j_ranges": _geo("SELECT p.oid, s.oid AS s_oid FROM geo_part p JOIN (SELECT oid, xmin AS low, xmin + CASE WHEN oid % 10 = 0 THEN 900.0::DOUBLE ELSE 20.0::DOUBLE END AS high FROM geo_supplier) s ON p.x BETWEEN s.low AND s.high"),
    "j_shapes_meet": _geo("SELECT a.oid AS a_oid, b.oid AS b_oid FROM geo_supplier a JOIN geo_supplier b ON a.oid < b.oid AND a.xmax >= b.xmin AND a.xmin <= b.xmax AND a.ymax >= b.ymin AND a.ymin <= b.ymax"),
    "j_boxes_of_all_sizes": _geo("SELECT s.oid AS b_oid, count(*) AS n FROM geo_part p JOIN (SELECT oid, CASE WHEN oid % 9 = 0 THEN 'inf'::DOUBLE WHEN oid % 9 = 1 THEN 1e7 ELSE 500.0 END AS w, xmin + 500.0::DOUBLE AS lo, xmax - 500.0::DOUBLE AS hi, ymin, ymax FROM geo_supplier) s ON p.y < 20 AND p.x BETWEEN s.lo - s.w AND s.hi + s.w AND p.y BETWEEN s.ymin AND s.ymax GROUP BY s.oid"),
    "o_oid_order": _geo("SELECT oid FROM geo_supplier WHERE xmax >= 0 AND xmin <= 3000 AND ymax >= 5 AND ymin <= 12 ORDER BY oid LIMIT 25"),
    "o_blob_order": "SELECT c_nationkey, min(right(c_name, 3)) AS least, max(right(c_name, 3)) AS most FROM customer GROUP BY c_nationkey",
    "b_envelopes": _geo(
        """SELECT 'both' AS name, least(p.xmin, s.xmin) AS xmin, least(p.ymin, s.ymin) AS ymin, greatest(p.xmax, s.xmax) AS xmax, greatest(p.ymax, s.ymax) AS ymax FROM p, s
        UNION ALL SELECT 'shared', greatest(p.xmin, s.xmin), greatest(p.ymin, s.ymin), least(p.xmax, s.xmax), least(p.ymax, s.ymax) FROM p, s UNION ALL SELECT 'wide', xmin - 2, ymin - 2, xmax + 2, ymax + 2 FROM p UNION ALL SELECT 'alone', xmin, ymin, xmax, ymax FROM p""",
        ", p AS (SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM geo_part), s AS (SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM geo_supplier)",
    ),
    "b_project": _geo("SELECT 'moved' AS name, round(least(0, (min(xmin) - 900) * (pi() / 180 * 6378137)), 3) AS xmin, 0.0::DOUBLE AS ymin, round(greatest(0, (min(xmin) - 880) * (pi() / 180 * 6378137)), 3) AS xmax, round(ln(tan(radians(max(ymax)) / 2 + pi() / 4)) * 6378137, 3) AS ymax FROM geo_part"),
    "b_with_z_and_m": _geo("SELECT oid, CAST(flat AND z AS INTEGER) AS z, CAST(flat AND z AND oid >= -5 AND -oid <= 5 AS INTEGER) AS zm, CAST(xmin >= 0 AND xmax <= 5000 AND ymin >= 0 AND ymax <= 20 AND oid >= 30 AND oid + 10 <= 60 AS INTEGER) AS holds_z, CAST(xmin <= 0 AND xmax >= 5000 AND ymin <= 0 AND ymax >= 20 AND oid >= 5 AS INTEGER) AS holds_m FROM (SELECT *, xmax >= 0 AND xmin <= 5000 AND ymax >= 0 AND ymin <= 20 AS flat, oid + 10 >= 30 AND oid <= 60 AS z FROM geo_supplier)"),
    "g_arrays": _geo("SELECT oid, round(sum(x), 3) AS x, round(sum(y), 3) AS y, round(sum(y * 2), 3) AS z, max(y) * 2 AS most_z, CAST(count(*) - 1 AS DOUBLE) AS most_m FROM geo_order_pt GROUP BY oid"),
    "g_blob_size": _geo("SELECT oid, CAST(81 + 4 + 16 * n_points AS INTEGER) AS stored, CAST(81 + 4 + 16 * n_points AS INTEGER) AS figured FROM geo_order"),
    "g_append": _geo("SELECT oid, 2 AS parts, CAST(2 * n_points AS INTEGER) AS points, 1 AS valid, 0 AS none, 0 AS same FROM geo_order"),
    "g_patches": "SELECT n_nationkey, ['triangle_strip', 'triangle_fan', 'outer_ring', 'inner_ring', 'first_ring', 'ring', 'triangles'][n_nationkey % 7 + 1] AS first, 'outer_ring' AS second, 5.0::DOUBLE * n_nationkey AS ymax FROM nation",
    "g_rotate": _geo("SELECT oid, round(x * cos(radians(30)) - y * sin(radians(30)), 4) AS x, round(x * sin(radians(30)) + y * cos(radians(30)), 4) AS y FROM geo_order_pt WHERE seq = 1"),
    "g_segments_meet": _geo(
        """SELECT oid, round(x + t * (x2 - x), 3) AS x, round(y + t * (y2 - y), 6) AS y, 1 AS near FROM (SELECT *, (-x * 60.0 + y * 80000.0) / k AS t, (-x * (y2 - y) + y * (x2 - x)) / k AS u
        FROM (SELECT *, (x2 - x) * 60.0 - (y2 - y) * 80000.0 AS k FROM segments s WHERE x2 IS NOT NULL AND NOT EXISTS (SELECT 1 FROM geo_order_pt q WHERE q.oid = s.oid AND q.seq = 1 AND (q.x <> s.x OR q.y <> s.y))) WHERE abs(k) > 1e-30) WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1""",
        _SEGMENTS,
    ),
    "g_relations": _geo(
        """SELECT a_oid, b_oid, CAST(meets AS INTEGER) AS meets, CAST(NOT meets AS INTEGER) AS apart, CAST(holds AS INTEGER) AS holds, CAST(inside AS INTEGER) AS inside, CAST(meets AND shared = 0 AS INTEGER) AS touches, CAST(holds AND inside AS INTEGER) AS same, CAST(shared > 0 AND NOT holds AND NOT inside AS INTEGER) AS overlaps
        FROM (SELECT *, ax1 >= bx0 AND ax0 <= bx1 AND ay1 >= by0 AND ay0 <= by1 AS meets, ax0 <= bx0 AND bx1 <= ax1 AND ay0 <= by0 AND by1 <= ay1 AS holds, bx0 <= ax0 AND ax1 <= bx1 AND by0 <= ay0 AND ay1 <= by1 AS inside FROM pairs)""",
        _FOUR,
    ),
    "g_overlays": _geo("SELECT a_oid, b_oid, round(shared, 4) AS both, round(one - shared, 4) AS only_a, round(one + two - shared, 4) AS either, round(one + two - 2 * shared, 4) AS one FROM (SELECT *, (ax1 - ax0) * (ay1 - ay0) AS one, (bx1 - bx0) * (by1 - by0) AS two FROM pairs)", _FOUR),
    "g_distance": _geo("SELECT a_oid, b_oid, round(sqrt(dx * dx + dy * dy), 4) AS distance FROM (SELECT a_oid, b_oid, greatest(0, bx0 - ax1, ax0 - bx1) AS dx, greatest(0, by0 - ay1, ay0 - by1) AS dy FROM pairs)", _FOUR),
    "g_hull": _geo("SELECT oid AS a_oid, 5 AS n_points, round((xmax - xmin + 100) * (ymax - ymin), 3) AS area, 1 AS simple FROM geo_supplier"),
    "g_buffer": _geo("SELECT oid, round((w + 3) * (h + 3), 3) AS miter, round(w * h + 3 * (w + h) + 4 * 0.5 * 2.25, 3) AS square, round(w * h + 3 * (w + h) + 4 * 8 * 0.5 * 2.25 * sin(pi() / 16), 3) AS round, round((w - 2) * (h - 2), 3) AS inner FROM (SELECT oid, xmax - xmin AS w, ymax - ymin AS h FROM geo_supplier)"),
    "g_simplify": _geo("SELECT oid, 9 AS before, 5 AS after, round(xmax, 4) AS mx, round(ymax, 4) AS my FROM geo_supplier"),
    "c_transverse_mercator": _system(f"0.5 * r * 0.9996::DOUBLE * ln((1 + cos(p) * sin({_L9})) / (1 - cos(p) * sin({_L9})))", f"r * 0.9996::DOUBLE * atan2(tan(p), cos({_L9}))"),
    "c_lambert_conic": _system(
        f"rho(p) * sin(n * {_L10})".replace("rho(p)", "r * f / pow(tan(pi() / 4 + p / 2), n)"), f"r * f / pow(tan(pi() / 4 + radians(30) / 2), n) - r * f / pow(tan(pi() / 4 + p / 2), n) * cos(n * {_L10})",
        f", (SELECT n, cos(radians(43)) * pow(tan(pi() / 4 + radians(43) / 2), n) / n AS f FROM {_CONIC})",
    ),
    "c_albers": _system(
        f"r / n * sqrt(c - 2 * n * sin(p)) * sin(n * {_L10})", f"r / n * sqrt(c - 2 * n * sin(radians(30))) - r / n * sqrt(c - 2 * n * sin(p)) * cos(n * {_L10})",
        f", (SELECT n, pow(cos(radians(43)), 2) + 2 * n * sin(radians(43)) AS c FROM {_ALBERS})",
    ),
    "c_lambert_azimuthal": _system(f"r * sqrt(2 / (1 + {_COS_C})) * {_EAST}", f"r * sqrt(2 / (1 + {_COS_C})) * {_NORTH}"),
    "c_stereographic": _system(f"2 * r / (1 + {_COS_C}) * {_EAST}", f"2 * r / (1 + {_COS_C}) * {_NORTH}"),
    "c_polar_stereographic": _system("2 * r * tan(pi() / 4 - p / 2) * sin(l)", "-2 * r * tan(pi() / 4 - p / 2) * cos(l)"),
    "c_equal_area_cylinder": _system("r * l * cos(radians(30))", "r * sin(p) / cos(radians(30))"),
    "c_equidistant": _system("r * l * cos(radians(30))", "r * p"),
    "c_utm_round_trip": _geo("SELECT oid, " + ", ".join(f"round(lon, 7) AS x{k}, round(lat, 7) AS y{k}" for k in range(4)) + " FROM lonlat", _LONLAT),
    "c_definitions": "SELECT * FROM (VALUES ('EPSG:4326', 'decimal_degrees', 1, 0, NULL::DOUBLE, -89.9::DOUBLE, 89.9::DOUBLE, 1), ('EPSG:3857', 'meters', 1, 1, 180.0, -89.9, 89.9, 1), ('EPSG:32633', 'meters', 1, 0, -165.0, -89.9, 89.9, 1), ('EPSG:5070', 'meters', 1, 0, 84.0, -90.0, 89.9, 1), ('EPSG:2154', 'meters', 1, 0, -177.0, -59.9, 89.9, 1)) AS v(code, units, itself, web, cut, low, high, unknown)",
    "m_extent_pruning": _geo("SELECT 1 AS layer_id, oid FROM geo_part WHERE xmax >= 910 AND xmin <= 950 AND ymax >= 10 AND ymin <= 30"),
    "m_box_to_device": _geo("SELECT oid, " + ", ".join(f"CAST(floor({sign}({c} - {o}) / k + 0.5) AS BIGINT) + {a} AS {n}" for n, c, o, a, sign in (("x0", "xmin", 950, 400, ""), ("y0", "ymax", 25, 300, "-"), ("x1", "xmax", 950, 400, ""), ("y1", "ymin", 25, 300, "-"))) + " FROM geo_supplier, (SELECT 1000.0 * (1 / 39.37::DOUBLE) / 96 AS k)"),
    "m_fit": _geo("SELECT (min(xmin) + max(xmax)) / 2 AS x, (min(ymin) + max(ymax)) / 2 AS y, round(greatest((max(xmax) - min(xmin)) / 800, (max(ymax) - min(ymin)) / 600), 9) AS ratio FROM geo_part"),
    "m_lengths": "SELECT p_partkey, round(p_size / k, 6) AS px, round(p_size * k, 6) AS units, round(p_size * 0.03937::DOUBLE * 96, 6) AS from_mm, round(p_size / 0.03937::DOUBLE / 96, 6) AS to_mm FROM part, (SELECT 1000.0 * (1 / 39.37::DOUBLE) / 96 AS k)",
    "m_shape_to_device": _geo(
        """SELECT oid, CAST(count(*) FILTER (WHERE b IS NULL OR a <> b) AS INTEGER) AS n_points FROM (SELECT oid, [px, py] AS a, lag([px, py]) OVER (PARTITION BY oid ORDER BY seq) AS b
        FROM (SELECT oid, seq, floor((x - 30000) / (1e8 * (1 / 39.37::DOUBLE) / 96) + 0.5) AS px, floor(-(y - 25) / (1e8 * (1 / 39.37::DOUBLE) / 96) + 0.5) AS py FROM geo_order_pt)) GROUP BY oid"""
    ),
    "m_clip_polygons": _geo("SELECT oid, round(greatest(0, least(xmax, 3000) - greatest(xmin, 0)) * greatest(0, least(ymax, 12) - greatest(ymin, 5)), 4) AS area FROM geo_supplier"),
    "m_matrix": "SELECT CAST(n_nationkey AS INTEGER) AS n, 5.0::DOUBLE - 6 * n_nationkey AS x, 7.0::DOUBLE + 2 * n_nationkey AS y, 5.0::DOUBLE AS z, 1 AS again, 5.0::DOUBLE AS mx, 7.0::DOUBLE AS my, 1.0::DOUBLE AS mz, 2.0::DOUBLE AS sx, 3.0::DOUBLE AS sy, 4.0::DOUBLE AS sz FROM nation",
    "m_phases": "SELECT CAST(k AS INTEGER) AS mask, concat_ws(',', CASE WHEN k & 1 > 0 THEN 'geography' END, CASE WHEN k & 2 > 0 THEN 'annotation' END, CASE WHEN k & 4 > 0 THEN 'selection' END, CASE WHEN k & 8 > 0 THEN 'graphics' END) AS drawn FROM range(16) AS t(k)",
    "x_text_forms": "SELECT n_nationkey, n_name AS fixed, CAST(2 + len(string_split_regex(trim(n_name), ' +')) AS INTEGER) AS n_args, 'two words' AS second, 'it''s' AS text, 12 AS number, CAST(n_regionkey AS VARCHAR) AS shown, '' AS blob FROM nation",
    "x_crc32": "SELECT n_nationkey, CAST(CASE n_nationkey " + " ".join(f"WHEN {k} THEN {zlib.crc32(str(k).encode())}" for k in range(25)) + " END AS BIGINT) AS crc FROM nation",
    "x_degrees": _geo("SELECT oid, round(y * 111194.8742964::DOUBLE, 4) AS meters FROM geo_part"),
    "x_round_trips": "SELECT c_custkey, 1 AS gcm, 1 AS cbc, 1 AS zlib, 1 AS zstd, 1 AS coder FROM customer",
    "x_json": "SELECT n_nationkey, CAST(1 + CAST(n_nationkey > 2 AS INTEGER) + CAST(n_regionkey > 2 AS INTEGER) AS INTEGER) AS large, n_regionkey AS b, CAST(n_nationkey + 1 AS INTEGER) AS k FROM nation",
    "k_statements": "SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey < 10 THEN lower(n_name) ELSE n_name END AS name, CASE WHEN n_nationkey < 10 THEN 'r' || (n_nationkey % 3) ELSE 'new' END AS state FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT 100, 'Atlantis, it''s gone', 'old'",
    "k_spatial_table": _geo("SELECT oid, ymin FROM geo_supplier WHERE xmax >= 0 AND xmin <= 3000 AND ymax >= 5 AND ymin <= 12"),
    "t_two_writers": "SELECT CAST(s_suppkey AS BIGINT) AS oid, 'first' AS state, 1 AS refused FROM supplier UNION ALL SELECT -1, 'new', 1 UNION ALL SELECT -2, 'new', 1",
    "s_encrypted": "SELECT CAST(n_nationkey AS BIGINT) AS oid, n_name AS name, 1 AS hidden FROM nation",
    "s_csv": "SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name FROM nation",
    "s_archive": "SELECT 'd/' || r_regionkey || '.txt' AS member, r_name AS text FROM region",
    "a_counters": "SELECT * FROM (VALUES ('insert', 1, 1, 1), ('delete', 1, 1, 1), ('commit', 2, 0, 1)) AS v(operation, n, wrote, took)",
    "u_map_layers": _geo("SELECT oid, 3 AS layers FROM geo_supplier WHERE xmax >= 0 AND xmin <= 3000 AND ymax >= 5 AND ymin <= 12"),
}
