"""Maps, routes, sidecar files, operation lists and their writers. One table per kind of content, not a file per route."""

from __future__ import annotations

import io
import json
import pickle
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymill.functions.wkt import line_coords

METADATA = "CRS string, CRS_map string, area_choice string, my_areas array<string>, map struct<CRS: string, CRS_map: string>, user_model struct<max_curb_height: double, min_sidewalk_width: double, crossing_weight_factor: double, walk_bike_preference: string, walk_bike_preference_weight_factor: double>"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Map metadata in flat or nested form, with both forms' columns; a missing file raises an error."""
    return spark.read.schema(METADATA).json(path, multiLine=True).select(
        F.coalesce("map.CRS", "CRS").alias("crs"), F.coalesce("map.CRS_map", "CRS_map").alias("crs_map"), "area_choice", "my_areas", "user_model"
    )


def read_map(spark: SparkSession, network: str, metadata: str) -> tuple[DataFrame, DataFrame]:
    """(network edges, metadata) of a map stored as a Parquet table and a JSON file."""
    return spark.read.parquet(network), read_metadata(spark, metadata)


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(route_id, coordinates, geometry) of ``;``-separated sidecar files; the route id is the number in the file name."""
    rows = spark.read.csv(path, sep=";", header=True, schema="coordinates string, geometry string", mode="PERMISSIVE", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return rows.select(route_number(name).alias("route_id"), "coordinates", "geometry")


def route_number(name):
    """The last number of a file name before its ending or its ``_start_end`` suffix, as text; null without one."""
    bare = F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9.]+$", ""), r"_start_end$", "")
    return F.nullif(F.regexp_extract(bare, r"(\d+)$", 1), F.lit(""))


def valid_routes(route_edges: DataFrame) -> DataFrame:
    """Rows of routes with at least one readable line; routes that are empty or have no geometry at all are left out."""
    good = route_edges.where(line_coords(F.col("geometry")).isNotNull()).select("route_id").distinct()
    return route_edges.join(good, "route_id", "left_semi")


def invalid_routes(route_edges: DataFrame) -> DataFrame:
    """(route_id): routes without a readable line."""
    good = route_edges.where(line_coords(F.col("geometry")).isNotNull()).select("route_id").distinct()
    return route_edges.where(F.col("route_id").isNotNull()).select("route_id").distinct().join(good, "route_id", "left_anti")


def write_routes(route_edges: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """One table, partitioned by map."""
    route_edges.write.mode(mode).partitionBy("map_id").parquet(path)


def write_sidecars(start_end: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Sidecar records as ``;``-separated text with a header."""
    start_end.select("coordinates", "geometry").write.mode(mode).csv(path, sep=";", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_tables(folder: str, tables: Mapping[str, DataFrame], *, mode: str = "overwrite") -> None:
    """Each table as a Parquet folder of its name."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder}/{name}")


class _FrameUnpickler(pickle.Unpickler):
    """Unpickles tables only: names of pandas, NumPy and a few plain ones. A guard against accidents, no sandbox: read files
    you trust."""

    #: What tables are made of beside pandas and NumPy.
    PLAIN = frozenset({("builtins", "slice"), ("builtins", "set"), ("builtins", "frozenset"), ("builtins", "list"), ("builtins", "dict"), ("builtins", "tuple"), ("collections", "OrderedDict"), ("_codecs", "encode"), ("datetime", "datetime"), ("datetime", "date")})
    INNER = ("pandas.core.", "pandas._libs.", "numpy.core.", "numpy._core.")

    def find_class(self, module: str, name: str):
        allowed = (module, name) in self.PLAIN or (module in ("pandas", "numpy") or module.startswith(self.INNER)) and "." not in name and name not in ("eval", "exec", "read_pickle", "load")
        if not allowed:
            raise pickle.UnpicklingError(f"{module}.{name} is no part of a table")
        return super().find_class(module, name)


def read_pickled_tables(spark: SparkSession, path: str, schema: str | T.StructType, *, glob: str = "*.df") -> DataFrame:
    """Existing pickled pandas tables, one per file, with the columns of ``schema`` by name; a column that a file lacks is
    null. Only for taking over stored data: executors hold a file whole, and a pickle with anything but a table in it is an
    error. What is written here is Parquet (``write_tables``)."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                frame = _FrameUnpickler(io.BytesIO(content)).load().reindex(columns=kind.names).astype(object)
                yield frame.where(frame.notna(), None)

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("content").mapInPandas(parse, kind)


def write_splits(features: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Features partitioned by split; a split without rows leaves nothing."""
    features.write.mode(mode).partitionBy("split").parquet(path)


def _operations(lists: DataFrame, *keys: str) -> DataFrame:
    """(keys, step, op, key, geometry, value) of rows with a stored list in ``ops``."""
    each = lists.select(*keys, F.posexplode(F.from_json("ops", "array<string>")).alias("step", "o"))
    parts = each.select(*keys, "step", F.from_json("o", "array<string>").alias("o")).withColumn("target", F.from_json(F.get("o", F.lit(1)), "array<string>"))
    at = lambda c, i: F.get(c, F.lit(i))
    return parts.where(at("o", 3) == "success").select(*keys, "step", at("o", 0).alias("op"), at("target", 0).alias("key"), at("target", 1).alias("geometry"), at("o", 2).alias("value"))


def read_operations(spark: SparkSession, path: str) -> DataFrame:
    """(file, step, op, key, geometry, value) of files that each hold one operation list ``[[op, [key, wkt], value, status],
    …]``: successful operations only, in order of ``step``."""
    return _operations(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("ops")), "file")


def operation_lists(operations: DataFrame, *keys: str) -> DataFrame:
    """(keys, ops): operations (step, op, key, geometry, value, status) folded to lists in the stored form, successful ones
    only."""

    def quoted(c: Column) -> Column:
        text = F.to_json(F.array(c.cast("string")))
        return text.substr(F.lit(2), F.length(text) - 2)

    op, key, geometry, value, status = (quoted(F.col(c)) for c in ("op", "key", "geometry", "value", "status"))
    row = F.concat(F.lit("["), op, F.lit(",["), key, F.lit(","), geometry, F.lit("],"), value, F.lit(","), status, F.lit("]"))
    folded = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", row.alias("r")))), lambda x: x.r), ",")
    return operations.where(F.col("status") == "success").groupBy(*keys).agg(F.concat(F.lit("["), folded, F.lit("]")).alias("ops"))


def write_operations(lists: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Operation lists of ``operation_lists`` as one table of JSON lines."""
    lists.write.mode(mode).json(path)


def read_operation_table(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """(keys, step, op, key, geometry, value) of what ``write_operations`` wrote; keys are text."""
    return _operations(spark.read.schema(", ".join(f"`{k}` string" for k in [*keys, "ops"])).json(path), *keys)


def write_metadata(metadata: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """One row of metadata, in flat or nested form, as a JSON file of its own."""
    metadata.coalesce(1).write.mode(mode).json(path)


def parse_operations(text: str) -> list[tuple]:
    """One stored list on the driver."""
    return [tuple(op) for op in json.loads(text) if op[3] == "success"]

