"""Queries of the general data-preparation problems (p1, p2, p4) and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymill.operators.impute import chained_imputation, filled_cells
from waymill.operators.nearby import classes_of_tables, nearby_of_tables
from waymill.sources.tables import table
from waymill.streaming.compact import compact, table_of_files


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells the imputer filled from other edges of the same street and kind."""
    cells = filled_cells(chained_imputation(table(spark, sf_dir, "network_map")))
    return cells.where((F.col("source") == "group") & F.col("value").isNotNull()).select("edge_id", "field_name")


def p1_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every filled cell with its value and where it came from."""
    return filled_cells(chained_imputation(table(spark, sf_dir, "network_map")))


def p1_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every filled cell and whether it was filled from its group or its time."""
    return filled_cells(chained_imputation(table(spark, sf_dir, "network_map"))).where(F.col("value").isNotNull()).select("edge_id", "field_name", "source")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct sidecar records of the tiny files, from the sealed table of the compactor."""
    return compact(spark, table_of_files(f"{sf_dir}/start_end_files.parquet"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points near points of other routes, near lines, and in areas."""
    return nearby_of_tables(table(spark, sf_dir, "start_end"), table(spark, sf_dir, "network_map"), table(spark, sf_dir, "map_areas"))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point with its place, and how many other places, lines and areas are near or around that."""
    return classes_of_tables(table(spark, sf_dir, "start_end"), table(spark, sf_dir, "network_map"), table(spark, sf_dir, "map_areas"))


QUERIES = {"p1_found": p1_found, "p1_sources": p1_sources, "p1_filled": p1_filled, "p2_found": p2_found, "p4_found": p4_found, "p4_classes": p4_classes}

#: Readable points, lines near them, and the edges of areas.
_P4 = r"""
        WITH raw AS (
            SELECT point_id, route_id, string_split_regex(trim(regexp_extract(geometry, '(?i)^\s*(SRID=\d+;)?\s*POINT\s*Z?\s*\(([-+0-9.eE\s]+)\)\s*$', 2)), '\s+') AS w
            FROM start_end),
        pt AS (
            SELECT DISTINCT point_id, route_id, TRY_CAST(w[1] AS DOUBLE) AS x, TRY_CAST(w[2] AS DOUBLE) AS y
            FROM raw WHERE TRY_CAST(w[1] AS DOUBLE) IS NOT NULL AND TRY_CAST(w[2] AS DOUBLE) IS NOT NULL),
        lines AS (
            SELECT DISTINCT edge_id, list_transform(string_split(regexp_extract(geometry, '(?i)LINESTRING\s*Z?\s*\(([^()]*)\)', 1), ','),
                   lambda p: string_split_regex(trim(p), '\s+')) AS c
            FROM network_map WHERE regexp_matches(geometry, '(?i)LINESTRING\s*Z?\s*\([^()]*\)')),
        vertex AS (
            SELECT edge_id, c, unnest(range(1, len(c))) AS k FROM lines),
        seg AS (
            SELECT DISTINCT edge_id, CAST(c[k][1] AS DOUBLE) AS x1, CAST(c[k][2] AS DOUBLE) AS y1, CAST(c[k + 1][1] AS DOUBLE) AS x2, CAST(c[k + 1][2] AS DOUBLE) AS y2
            FROM vertex),
        near_line AS (
            SELECT point_id, edge_id, x, y, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy,
                   CASE WHEN x1 = x2 AND y1 = y2 THEN 0
                        ELSE greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) END AS t
            FROM pt JOIN seg ON x BETWEEN least(x1, x2) - 6.01 AND greatest(x1, x2) + 6.01 AND y BETWEEN least(y1, y2) - 6.01 AND greatest(y1, y2) + 6.01),
        ring AS (
            SELECT DISTINCT area_id, unnest(regexp_extract_all(geometry, '\(([^()]+)\)', 1)) AS r FROM map_areas),
        corner AS (
            SELECT area_id, list_transform(string_split(r, ','), lambda p: string_split_regex(trim(p), '\s+')) AS c FROM ring),
        side AS (SELECT area_id, c, unnest(range(1, len(c))) AS k FROM corner),
        edge AS (
            SELECT area_id, CAST(c[k][1] AS DOUBLE) AS x1, CAST(c[k][2] AS DOUBLE) AS y1, CAST(c[k + 1][1] AS DOUBLE) AS x2, CAST(c[k + 1][2] AS DOUBLE) AS y2
            FROM side)"""

ORACLE = {
    "p1_found": """
        WITH cell AS (
            SELECT edge_id, street_id, path_type, 'curb_height_max' AS field_name,
                   CASE WHEN curb_height_max BETWEEN 0 AND 0.6 THEN 1 ELSE 0 END AS ok FROM network_map
            UNION ALL
            SELECT edge_id, street_id, path_type, 'obstacle_free_width_float',
                   CASE WHEN obstacle_free_width_float BETWEEN 0.2 AND 20 THEN 1 ELSE 0 END FROM network_map),
        edge AS (SELECT edge_id, field_name, max(ok) AS ok FROM cell GROUP BY ALL),
        grp AS (SELECT DISTINCT street_id, path_type, field_name FROM cell WHERE ok = 1),
        member AS (SELECT DISTINCT edge_id, street_id, path_type, field_name FROM cell)
        SELECT DISTINCT m.edge_id, m.field_name
        FROM member m JOIN edge e USING (edge_id, field_name) JOIN grp g USING (street_id, path_type, field_name)
        WHERE e.ok = 0""",
    "p2_found": r"""
        WITH line AS (
            SELECT regexp_extract(file_path, 'route_([^/]+)_walk_(\d+)_start_end[^/]*$', 1) AS map_id,
                   TRY_CAST(regexp_extract(file_path, 'route_([^/]+)_walk_(\d+)_start_end[^/]*$', 2) AS BIGINT) AS route_no,
                   replace(unnest(regexp_split_to_array(body, '\r\n|\n|\r')), chr(65279), '') AS line
            FROM start_end_files),
        field AS (
            SELECT map_id, route_no, regexp_extract_all(line, '"[^"]*"|[^;"]+') AS f FROM line WHERE map_id <> ''),
        pair AS (
            SELECT map_id, route_no, lower(trim(replace(f[1], '"', ''))) AS a, lower(trim(replace(f[2], '"', ''))) AS b
            FROM field WHERE len(f) = 2),
        rec AS (
            SELECT map_id, route_no, a AS coordinates, b AS g FROM pair WHERE a IN ('origin', 'destination', 'origin_node', 'destination_node')
            UNION ALL
            SELECT map_id, route_no, b, a FROM pair WHERE b IN ('origin', 'destination', 'origin_node', 'destination_node')),
        xy AS (
            SELECT map_id, route_no, coordinates,
                   regexp_extract(g, '^(srid=\d+;)?\s*point\s*z?\s*\(\s*([-+0-9.e]+)\s+([-+0-9.e]+)(\s+[-+0-9.e]+)?\s*\)$', ['s', 'x', 'y', 'z']) AS m FROM rec)
        SELECT DISTINCT map_id, route_no, coordinates,
               CAST(round(TRY_CAST(m.x AS DOUBLE) * 100) AS BIGINT) AS x_cm, CAST(round(TRY_CAST(m.y AS DOUBLE) * 100) AS BIGINT) AS y_cm
        FROM xy WHERE TRY_CAST(m.x AS DOUBLE) IS NOT NULL AND TRY_CAST(m.y AS DOUBLE) IS NOT NULL""",
    "p1_sources": """
        WITH cell AS (
            SELECT edge_id, street_id, path_type, 'curb_height_max' AS field_name, CASE WHEN curb_height_max BETWEEN 0 AND 0.6 THEN 1 ELSE 0 END AS ok FROM network_map
            UNION ALL
            SELECT edge_id, street_id, path_type, 'obstacle_free_width_float', CASE WHEN obstacle_free_width_float BETWEEN 0.2 AND 20 THEN 1 ELSE 0 END FROM network_map),
        lacks AS (SELECT edge_id, field_name FROM cell GROUP BY ALL HAVING max(ok) = 0),
        grp AS (SELECT DISTINCT street_id, path_type, field_name FROM cell WHERE ok = 1)
        SELECT l.edge_id, l.field_name, CASE WHEN count(g.field_name) > 0 THEN 'group' ELSE 'time' END AS source
        FROM lacks l JOIN cell c USING (edge_id, field_name) LEFT JOIN grp g ON g.street_id = c.street_id AND g.path_type = c.path_type AND g.field_name = c.field_name GROUP BY l.edge_id, l.field_name""",
    "p4_found": _P4 + """
        SELECT 'point' AS kind, a.point_id AS left_id, b.point_id AS right_id
        FROM pt a JOIN pt b ON a.point_id < b.point_id AND a.route_id <> b.route_id AND b.x BETWEEN a.x - 10.01 AND a.x + 10.01
        WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 100 + 1e-6
        UNION ALL
        SELECT DISTINCT 'line', point_id, edge_id FROM near_line WHERE (x - x1 - t * dx) ** 2 + (y - y1 - t * dy) ** 2 <= 36 + 1e-6
        UNION ALL
        SELECT 'area', point_id, area_id FROM pt JOIN edge ON y >= least(y1, y2) AND y < greatest(y1, y2) AND x1 + (y - y1) * (x2 - x1) / (y2 - y1) < x
        GROUP BY point_id, area_id HAVING count(*) % 2 = 1""",
    "p4_classes": _P4
    + """,
        place AS (SELECT min(point_id) AS place_id, x, y FROM pt GROUP BY x, y),
        near_place AS (
            SELECT a.place_id, count(*) AS n FROM place a JOIN place b ON a.place_id <> b.place_id AND b.x BETWEEN a.x - 10.01 AND a.x + 10.01
            WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 100 + 1e-6 GROUP BY a.place_id),
        line_of AS (SELECT point_id, count(DISTINCT edge_id) AS n FROM near_line WHERE (x - x1 - t * dx) ** 2 + (y - y1 - t * dy) ** 2 <= 36 + 1e-6 GROUP BY point_id),
        inside AS (
            SELECT point_id, area_id FROM pt JOIN edge ON y >= least(y1, y2) AND y < greatest(y1, y2) AND x1 + (y - y1) * (x2 - x1) / (y2 - y1) < x
            GROUP BY point_id, area_id HAVING count(*) % 2 = 1),
        area_of AS (SELECT point_id, count(*) AS n FROM inside GROUP BY point_id)
        SELECT point_id, place_id, coalesce(p.n, 0) AS n_places, coalesce(l.n, 0) AS n_lines, coalesce(a.n, 0) AS n_areas
        FROM pt JOIN place USING (x, y) LEFT JOIN near_place p USING (place_id) LEFT JOIN line_of l USING (point_id) LEFT JOIN area_of a USING (point_id)""",
}
