"""Checkpointed streaming compaction of tiny files.

A file stream discovers each file once (its log is in the checkpoint), takes what is available in batches of
bounded bytes, and writes every batch to a folder named by the batch id. A batch that is run again after a failure
replaces its own folder, so nothing is duplicated. Sealing takes the new batches into the sealed table, each distinct
record once, in files near the advisory partition size (AQE splits and merges the rebalanced partitions), and makes
them visible at once by a manifest.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymill.functions.wkt import centimetres, point_xy
from waymill.session import removed, scratch_path

#: The labels of a sidecar record.
LABELS = ("origin", "destination", "origin_node", "destination_node")

#: Beyond any real age: a file is new if its path is not in the checkpoint, however old it is. Spark's default of 7 days
#: would leave out files that arrive late with an old modification time.
MAX_FILE_AGE = "1000000d"

FILES = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("body", T.StringType()),
        T.StructField("modified_at", T.TimestampNTZType()),
    ]
)


def sidecar_records(files: DataFrame) -> DataFrame:
    """The records of sidecar files (columns file_path, body): map_id, route_no, coordinates, x_cm, y_cm.

    A record is a line with one of the four labels and a complete point, in either order. Null and empty bodies,
    headers, comments, unknown labels, truncated points, and files whose name holds no map and route give none.
    The same record can come out several times; ``compact`` removes repeats.
    """
    label = "(" + "|".join(sorted(LABELS, key=len, reverse=True)) + ")"
    blank, geometry = r'[\s"\x{FEFF}]*', r'\s*("[^"]*"|[^;"]*?)\s*'
    forward, backward = rf"(?i)^{blank}{label}{blank};{geometry}[;\s]*$", rf"(?i)^[\s\x{{FEFF}}]*{geometry};{blank}{label}{blank}[;\s]*$"
    name = F.element_at(F.split(F.col("file_path"), r"[/\\]"), -1)
    named = r"(?i)route_(.+)_walk_(\d+)_start_end"
    lines = files.where(F.col("body").isNotNull() & (F.col("body") != "")).select(
        F.regexp_extract(name, named, 1).alias("map_id"),
        F.regexp_extract(name, named, 2).try_cast("bigint").alias("route_no"),
        F.explode(F.split("body", r"\r\n|\n|\r")).alias("line"),
    )
    lines = lines.where((F.col("map_id") != "") & F.col("route_no").isNotNull() & F.col("line").contains(";"))
    ahead = F.regexp_extract("line", forward, 1)
    parts = lines.select(
        "map_id",
        "route_no",
        F.lower(F.when(ahead != "", ahead).otherwise(F.regexp_extract("line", backward, 2))).alias("coordinates"),
        F.when(ahead != "", F.regexp_extract("line", forward, 2)).otherwise(F.regexp_extract("line", backward, 1)).alias("text"),
    ).where(F.col("coordinates") != "")
    placed = parts.withColumn("xy", point_xy(F.regexp_replace("text", '"', ""))).where(F.col("xy").isNotNull())
    return placed.select("map_id", "route_no", "coordinates", centimetres(F.col("xy.x")).alias("x_cm"), centimetres(F.col("xy.y")).alias("y_cm"))


def binary_files(path: str, glob: str = "*") -> Callable[[SparkSession, int], DataFrame]:
    """A stream over a folder tree of real tiny files, as (file_path, body)."""

    def load(spark: SparkSession, max_bytes: int) -> DataFrame:
        raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFileAge", MAX_FILE_AGE).option("maxBytesPerTrigger", str(max_bytes)).load(path)
        return raw.select(F.col("path").alias("file_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("body"))

    return load


def table_of_files(path: str, schema: T.StructType = FILES) -> Callable[[SparkSession, int], DataFrame]:
    """A stream over a Parquet table that holds one tiny file per row."""

    def load(spark: SparkSession, max_bytes: int) -> DataFrame:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
        if status.isFile():  # a stream watches folders: its folder then, with the one name
            folder, _, name = path.rpartition("/")
            return spark.readStream.schema(schema).option("maxFileAge", MAX_FILE_AGE).option("maxBytesPerTrigger", str(max_bytes)).option("pathGlobFilter", name).parquet(folder)
        return spark.readStream.schema(schema).option("maxFileAge", MAX_FILE_AGE).option("maxBytesPerTrigger", str(max_bytes)).parquet(path)

    return load


def wave_bytes(spark: SparkSession) -> int:
    """What one wave of tasks reads: a file partition for every core of the session."""
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return max(1, spark.sparkContext.defaultParallelism) * int(size)


def ingest(
    spark: SparkSession,
    source: Callable[[SparkSession, int], DataFrame],
    parse: Callable[[DataFrame], DataFrame],
    landing: str,
    checkpoint: str,
    *,
    max_bytes: int | None = None,
) -> None:
    """Take all files not yet seen by ``checkpoint`` into ``landing``; returns when none is left.

    A batch has at most about ``max_bytes`` (``wave_bytes``, if not given), but at least one file: a larger file is a
    batch of its own.

    May be called again at any time, after a failure too: the checkpoint knows which files and which batch are open.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        # the same batch id always names the same files, so overwriting its folder makes a retry harmless
        batch.dropDuplicates().hint("rebalance").write.mode("overwrite").parquet(f"{landing}/batch={batch_id}")

    query = parse(source(spark, max_bytes or wave_bytes(spark))).writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


#: Sealed parts below this size are taken into the next part; a part beyond it stays as it is.
SMALL_PART = 1 << 30


class Sealed:
    """A sealed table: parts, and numbered manifests that name the valid ones and the last batch they hold. Parts are written
    before a manifest names them, and a manifest appears by a rename, so a reader and a later run see the state before a
    seal or the one after it, whenever a run breaks off."""

    def __init__(self, spark: SparkSession, target: str) -> None:
        self.spark, self.target = spark, target
        self.place = spark._jvm.org.apache.hadoop.fs.Path(target)
        self.files = self.place.getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str, pattern: str) -> dict[str, tuple[int, bool]]:
        """(number, whether a folder) by the names that match the pattern's one number."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        found = {}
        for entry in self.files.listStatus(place) if self.files.exists(place) else []:
            if match := re.fullmatch(pattern, entry.getPath().getName()):
                found[entry.getPath().getName()] = (int(match[1]), entry.isDirectory())
        return found

    def state(self) -> tuple[int, list[str], int]:
        """(number of the last manifest, its parts, its last batch); 0, none and -1 before the first."""
        manifests = self.names(self.target, r"manifest-(\d+)\.json")
        if not manifests:
            return 0, [], -1
        name = max(manifests, key=lambda n: manifests[n][0])
        content = json.loads("".join(r[0] for r in self.spark.read.text(f"{self.target}/{name}").collect()))
        return manifests[name][0], content["parts"], content["batch"]

    def commit(self, number: int, parts: list[str], batch: int) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        draft = path(f"{self.target}/_draft-{number}.json")
        out = self.files.create(draft, True)
        out.write(bytearray(json.dumps({"parts": parts, "batch": batch}).encode()))
        out.close()
        if not self.files.rename(draft, path(f"{self.target}/manifest-{number}.json")):
            raise RuntimeError(f"{self.target}: manifest {number} is there already; another run seals this table")

    def bytes_of(self, part: str) -> int:
        return self.files.getContentSummary(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.target}/{part}")).getLength()

    def read(self, parts: Sequence[str], schema: T.StructType) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.target}/{p}" for p in parts])


def seal(spark: SparkSession, landing: str, target: str, schema: T.StructType, *, key: Sequence[str | Column] | None = None, small_part: int = SMALL_PART) -> DataFrame:
    """Take the batches of ``landing`` that aren't sealed yet into ``target``, each distinct record once, in well-sized
    files; returns the sealed table.

    New records, those of parts below ``small_part`` bytes, and none that a larger part holds, become one new part; then a
    manifest names the valid parts, and what it no longer needs is removed: parts taken in, landed batches, remains of runs
    that broke off. So a seal writes again only what is small, and reads of the rest what it compares. ``key``: the columns
    that spread records over files (all, if not given). An empty landing gives an empty table.
    """
    table = Sealed(spark, target)
    number, parts, last = table.state()
    landed = table.names(landing, r"batch=(-?\d+)")
    fresh = sorted((k, name) for name, (k, folder) in landed.items() if folder and k > last)
    if fresh:
        small = [p for p in parts if table.bytes_of(p) < small_part]
        large = [p for p in parts if p not in small]
        rows = spark.read.schema(schema).parquet(*[f"{landing}/{name}" for _, name in fresh])
        rows = rows.unionByName(table.read(small, schema)) if small else rows
        rows = rows.subtract(table.read(large, schema)) if large else rows.dropDuplicates()  # a set difference: distinct as well
        number, parts, last = number + 1, [*large, f"part-{number + 1}"], fresh[-1][0]
        rows.hint("rebalance", *(key or [])).write.mode("overwrite").parquet(f"{target}/{parts[-1]}")
        table.commit(number, parts, last)
    for name, (k, _) in landed.items():
        if k <= last:
            removed(spark, f"{landing}/{name}")
    for name in table.names(target, r"part-(\d+)"):
        if name not in parts:
            removed(spark, f"{target}/{name}")
    for name, (k, _) in table.names(target, r"(?:manifest|_draft)-(\d+)\.json").items():
        if k < number:
            removed(spark, f"{target}/{name}")
    return table.read(parts, schema)


RECORD = T.StructType(
    [
        T.StructField("map_id", T.StringType()),
        T.StructField("route_no", T.LongType()),
        T.StructField("coordinates", T.StringType()),
        T.StructField("x_cm", T.LongType()),
        T.StructField("y_cm", T.LongType()),
    ]
)


def compact(spark: SparkSession, source: Callable[[SparkSession, int], DataFrame], *, workdir: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """Sidecar files from ``source`` to one sealed table of distinct records below ``workdir`` (the shared folder if
    not given). A second call with the same ``workdir`` takes in new files only and seals what they add. One run at a
    time works on a ``workdir``."""
    root = workdir or scratch_path(spark, "compact")
    landing = f"{root}/landing"
    ingest(spark, source, sidecar_records, landing, f"{root}/checkpoint", max_bytes=max_bytes)
    return seal(spark, landing, f"{root}/sealed", RECORD)
