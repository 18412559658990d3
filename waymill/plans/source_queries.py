"""Queries over sources and sinks: tables are written to the shared folder and read back. Their SQL counterparts read the
tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymill.operators import routes
from waymill.session import scratch_path
from waymill.sources import files, geopackage
from waymill.sources.tables import table


def stored_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes written by map and read back, rows of valid routes only."""
    path = scratch_path(spark, "routes")
    files.write_routes(table(spark, d, "route_edges"), path)
    back = spark.read.parquet(path)
    return files.valid_routes(back).select("route_id", F.col("map_id").cast("string").alias("map_id"), "step_id", "edge_id", F.md5(F.coalesce("geometry", F.lit("-"))).alias("line"))


def stored_sidecars(spark: SparkSession, d: str) -> DataFrame:
    """Start and end points written as ``;``-separated text with a header and read back, per label and text."""
    path = scratch_path(spark, "sidecars")
    files.write_sidecars(table(spark, d, "start_end"), path)
    back = files.read_sidecars(spark, path)
    return back.groupBy("coordinates", F.coalesce("geometry", F.lit("")).alias("geometry")).agg(F.count(F.lit(1)).alias("n"))


def stored_tables(spark: SparkSession, d: str) -> DataFrame:
    """Two named tables written and read back: their rows."""
    path = scratch_path(spark, "tables")
    files.write_tables(path, {"train": table(spark, d, "sampled_train"), "eval": table(spark, d, "sampled_eval")})
    count = lambda name: spark.read.parquet(f"{path}/{name}").groupBy("map_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("feature_vec").cast("bigint")).alias("n_slots")).select(F.lit(name).alias("name"), "*")
    return count("train").unionByName(count("eval"))


def stored_splits(spark: SparkSession, d: str) -> DataFrame:
    """Steps of routes written by the split of their route and read back."""
    edges = table(spark, d, "route_edges")
    member = routes.split_members(routes.matched_routes(edges, table(spark, d, "start_end")), train=0.8, validation=0.1, test=0.1)
    path = scratch_path(spark, "splits")
    files.write_splits(edges.select("route_id", "step_id").join(member.withColumnRenamed("id", "route_id"), "route_id"), path)
    return spark.read.parquet(path).groupBy(F.col("split").cast("string").alias("split"), "route_id").agg(F.count(F.lit(1)).alias("n_rows"))


def stored_operations(spark: SparkSession, d: str) -> DataFrame:
    """Operation lists of routes (an operation per stored step; of excluded edges it failed) folded, written and read back."""
    step = F.struct("path_type", F.col("edge_id").cast("string").alias("key"), "geometry", F.col("bikepath_id").alias("value"), F.when(F.col("include") == 1, "success").otherwise("failed").alias("status"))
    one = table(spark, d, "route_edges").groupBy("route_id", F.col("step_id").alias("step")).agg(F.min(step).alias("s"))
    operations = one.select("route_id", "step", F.col("s.path_type").alias("op"), "s.key", "s.geometry", "s.value", "s.status")
    path = scratch_path(spark, "operations")
    files.write_operations(files.operation_lists(operations, "route_id"), path)
    back = files.read_operation_table(spark, path, "route_id")
    return back.select("route_id", F.col("step").cast("bigint").alias("place"), "op", "key", "geometry", "value")


def loaded_map(spark: SparkSession, d: str) -> DataFrame:
    """The network and its metadata, in flat and in nested form, written and loaded together: edges per map with the
    limits of the standard user model."""
    path = scratch_path(spark, "map")
    files.write_tables(path, {"network": table(spark, d, "network_map")})
    crs = spark.range(1).select(F.lit("EPSG:28992").alias("CRS"), F.lit("EPSG:4326").alias("CRS_map"))
    model = table(spark, d, "user_model").where("profile_id = 'um_std'").drop("profile_id")
    files.write_metadata(crs.select(F.struct("CRS", "CRS_map").alias("map")).crossJoin(model.select(F.struct(*model.columns).alias("user_model"))), f"{path}/nested")
    files.write_metadata(crs, f"{path}/flat")

    def counted(form: str) -> DataFrame:
        network, metadata = files.read_map(spark, f"{path}/network", f"{path}/{form}")
        rows = network.groupBy("map_id").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(metadata))  # one row of metadata
        return rows.select(F.lit(form).alias("form"), "map_id", "n", "crs", "crs_map", F.floor(F.col("user_model.max_curb_height") * 1e4 + 0.5).cast("bigint").alias("curb"))

    return counted("flat").unionByName(counted("nested"))


def listed_maps(spark: SparkSession, d: str) -> DataFrame:
    """Maps of the Parquet files of stored routes, by listing the folder."""
    path = scratch_path(spark, "listing")
    files.write_routes(table(spark, d, "route_edges").select("route_id", "map_id"), path)
    found = geopackage.list_files(spark, path, "*.parquet")
    return found.where("n_bytes > 0").select(F.regexp_extract("path", "map_id=([^/]+)/", 1).alias("map_id")).distinct()


QUERIES = {f.__name__: f for f in (stored_routes, stored_sidecars, stored_tables, stored_splits, stored_operations, loaded_map, listed_maps)}

_READABLE = r"regexp_matches(geometry, '(?i)LINESTRING\s*Z?\s*\([^()]*\)')"

ORACLE = {
    "stored_routes": f"SELECT route_id, map_id, step_id, edge_id, md5(coalesce(geometry, '-')) AS line FROM route_edges WHERE route_id IN (SELECT route_id FROM route_edges WHERE {_READABLE})",
    "stored_sidecars": "SELECT coordinates, coalesce(geometry, '') AS geometry, count(*) AS n FROM start_end GROUP BY ALL",
    "stored_tables": """
        SELECT 'train' AS name, map_id, count(*) AS n_rows, CAST(sum(len(feature_vec)) AS BIGINT) AS n_slots FROM sampled_train GROUP BY map_id
        UNION ALL SELECT 'eval', map_id, count(*), CAST(sum(len(feature_vec)) AS BIGINT) FROM sampled_eval GROUP BY map_id""",
    "stored_splits": """
        WITH ids AS (SELECT DISTINCT route_id FROM route_edges WHERE route_id IN (SELECT route_id FROM start_end)),
        placed AS (SELECT *, row_number() OVER (ORDER BY substr(md5('1:' || route_id), 1, 4), route_id) AS k, count(*) OVER () AS n FROM ids)
        SELECT CASE WHEN k <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN k <= floor(n * CAST(0.8 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split, route_id, count(*) AS n_rows
        FROM placed JOIN route_edges USING (route_id) GROUP BY ALL""",
    "stored_operations": """
        WITH one AS (
            SELECT *, row_number() OVER (PARTITION BY route_id, step_id ORDER BY path_type NULLS FIRST, CAST(edge_id AS VARCHAR) NULLS FIRST, geometry NULLS FIRST, bikepath_id NULLS FIRST, include <> 1) AS rn FROM route_edges)
        SELECT route_id, row_number() OVER (PARTITION BY route_id ORDER BY step_id) - 1 AS place, path_type AS op, CAST(edge_id AS VARCHAR) AS key, geometry, bikepath_id AS value FROM one WHERE rn = 1 AND include = 1""",
    "loaded_map": """
        SELECT form, map_id, count(*) AS n, 'EPSG:28992' AS crs, 'EPSG:4326' AS crs_map, CASE WHEN form = 'nested' THEN CAST(floor(max(max_curb_height) * 1e4 + 0.5) AS BIGINT) END AS curb
        FROM network_map, (VALUES ('flat'), ('nested')) AS f(form), user_model WHERE profile_id = 'um_std' GROUP BY form, map_id""",
    "listed_maps": "SELECT DISTINCT map_id FROM route_edges",
}
