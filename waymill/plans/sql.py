"""Statements shared by SQL counterparts."""

LINES = r"""
    WITH lines AS (
        SELECT *, list_transform(string_split(regexp_extract(geometry, '(?i)LINESTRING\s*Z?\s*\(([^()]*)\)', 1), ','), lambda p: string_split_regex(trim(p), '\s+')) AS c
        FROM network_map WHERE regexp_matches(geometry, '(?i)LINESTRING\s*Z?\s*\([^()]*\)'))"""

EDGES = LINES + """,
    picked AS (
        SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY loaded_at NULLS LAST, surveyed_at NULLS LAST, geometry NULLS LAST, length NULLS LAST,
               obstacle_free_width_float NULLS LAST, curb_height_max NULLS LAST, crossing NULLS LAST, include NULLS LAST) AS rn FROM lines),
    edges AS (
        SELECT edge_id, map_id, street_id, path_type, bikepath_id, crossing, include, c, len(c) AS n_vertices,
               CASE WHEN isnan(length) THEN NULL ELSE length END AS length,
               CASE WHEN isnan(obstacle_free_width_float) THEN NULL ELSE obstacle_free_width_float END AS width,
               CASE WHEN isnan(curb_height_max) THEN NULL ELSE curb_height_max END AS curb,
               CAST(floor(CAST(c[1][1] AS DOUBLE) * 100 + 0.5) AS BIGINT) AS x1, CAST(floor(CAST(c[1][2] AS DOUBLE) * 100 + 0.5) AS BIGINT) AS y1,
               CAST(floor(CAST(c[-1][1] AS DOUBLE) * 100 + 0.5) AS BIGINT) AS x2, CAST(floor(CAST(c[-1][2] AS DOUBLE) * 100 + 0.5) AS BIGINT) AS y2
        FROM picked WHERE rn = 1)"""
