"""GeoPackage files as rows with WKT geometry: ``read_geopackages`` for any file system, and a Spark data source for files
that each machine sees under the same path, one partition per file.

    spark.dataSource.register(GeoPackageSource)
    spark.read.format("geopackage").schema("edge_id bigint, geometry string, length double").load("folder/*.gpkg")

Columns are taken by name; a column the file lacks is null; ``source_file`` gives the file's path.
"""

from __future__ import annotations

import glob
import os
import sqlite3
import struct
from collections.abc import Iterator
from contextlib import closing
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: WKB codes and the bytes of each envelope kind.
WKB_POINT, WKB_LINE, WKB_POLYGON = 1, 2, 3
ENVELOPE_BYTES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


def wkb_to_wkt(blob: bytes) -> str | None:
    """A GeoPackage geometry blob or plain WKB as WKT; null, empty and unknown kinds give None. Z and M are dropped."""
    if not blob:
        return None
    if blob[:2] == b"GP":
        flags = blob[3]
        if flags & 0b10000:
            return None
        blob = blob[8 + ENVELOPE_BYTES.get((flags >> 1) & 7, 0) :]
    order = "<" if blob[0] == 1 else ">"
    code = struct.unpack_from(order + "I", blob, 1)[0]
    extra = (code // 1000) % 4 if code < 0x10000000 else ((code >> 31) & 1) + ((code >> 30) & 1)
    width = 2 + (0 if not extra else 1 if extra in (1, 2) else 2)
    kind, at = code % 1000 & 0xFF, 5

    def positions(count: int, at: int) -> tuple[str, int]:
        values = struct.unpack_from(f"{order}{count * width}d", blob, at)
        return ", ".join(f"{values[k]!r} {values[k + 1]!r}" for k in range(0, len(values), width)), at + 8 * count * width

    if kind == WKB_POINT:
        return f"POINT ({positions(1, at)[0]})"
    if kind == WKB_LINE:
        count = struct.unpack_from(order + "I", blob, at)[0]
        return f"LINESTRING ({positions(count, at + 4)[0]})" if count else None
    if kind == WKB_POLYGON:
        rings, parts = struct.unpack_from(order + "I", blob, at)[0], []
        at += 4
        for _ in range(rings):
            count = struct.unpack_from(order + "I", blob, at)[0]
            text, at = positions(count, at + 4)
            parts.append(f"({text})")
        return f"POLYGON ({', '.join(parts)})" if parts else None
    return None


def _rows(db: sqlite3.Connection, names: list[str], layer: str | None, path: str) -> Iterator[tuple]:
    """The rows of a feature layer (the first, if none is named) with the columns ``names``."""
    layer = layer or next(iter(db.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY table_name")), (None,))[0]
    if layer is None:
        return
    shape = next(iter(db.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,))), ("geom",))[0]
    quoted = layer.replace('"', '""')
    rows = db.execute(f'SELECT * FROM "{quoted}"')
    at = {d[0]: k for k, d in enumerate(rows.description)}
    for row in rows:
        yield tuple(path if n == "source_file" else wkb_to_wkt(row[at[shape]]) if n == "geometry" and shape in at else row[at[n]] if n in at else None for n in names)


def read_geopackages(spark: SparkSession, path: str, schema: str | StructType, *, layer: str | None = None, glob: str = "*.gpkg") -> DataFrame:
    """GeoPackage files of a file, folder or tree in any file system that Spark reads, with the columns of ``schema`` by
    name: one column that a file lacks is null, ``geometry`` is WKT, ``source_file`` the file's path. Executors fetch the
    files and open them in memory, so files are those of a route or a map, below 2 GB each. A file that is no GeoPackage
    is an error."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    names = kind.names

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = to_arrow_schema(kind)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with closing(sqlite3.connect(":memory:")) as db:
                    db.deserialize(content.as_py())
                    rows = _rows(db, names, layer, name)
                    while some := list(islice(rows, 10_000)):
                        yield pa.RecordBatch.from_arrays([pa.array(values, f.type) for values, f in zip(zip(*some, strict=True), fields, strict=True)], schema=fields)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(parse, kind)


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, n_bytes) of the files below a folder in any file system that Spark reads; their content isn't."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("n_bytes"))


class FilePartition(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class GeoPackageReader(DataSourceReader):
    def __init__(self, schema: StructType, paths: str, layer: str | None) -> None:
        self.schema, self.paths, self.layer = schema, paths, layer

    def partitions(self) -> list[FilePartition]:
        pattern = os.path.join(self.paths, "*.gpkg") if os.path.isdir(self.paths) else self.paths
        return [FilePartition(p) for p in sorted(glob.glob(pattern))]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        names = [f.name for f in self.schema.fields]
        with closing(sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True)) as db:
            yield from _rows(db, names, self.layer, partition.path)


class GeoPackageSource(DataSource):
    """Options: ``path`` (file, folder or glob), ``layer`` (the first feature layer, if not given)."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> str:
        return "edge_id bigint, geometry string, source_file string"

    def reader(self, schema: StructType) -> GeoPackageReader:
        return GeoPackageReader(schema, self.options["path"], self.options.get("layer"))
