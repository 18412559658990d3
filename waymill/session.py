"""Session settings shared by queries, tests and the bench."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter's session is used as it is."""
    builder = SparkSession.builder.master(master).appName("waymill").config("spark.driver.memory", memory)
    for key, value in CONF.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Only a local session, as in tests, may name none: a
    temporary folder takes its place for the life of the application. On a cluster, where it would be another folder on
    each machine, that is an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='waymill-')}"
        spark.conf.set("spark.checkpoint.dir", named)
        _expires(spark, named)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(named)
    _expires(spark, context._jsc.sc().getCheckpointDir().get())  # this application's own folder below the shared one
    return named.rstrip("/")


def _folder(spark: SparkSession, path: str):
    """(file system, path) on the JVM."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _expires(spark: SparkSession, path: str) -> None:
    """Have a folder removed when the application ends; it is made if it isn't there, for only then it is noted."""
    system, place = _folder(spark, path)
    system.mkdirs(place)
    system.deleteOnExit(place)


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder now; one that isn't there is none to remove."""
    system, place = _folder(spark, path)
    system.delete(place, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed at the application's end."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    _expires(spark, path)
    return path


_SCRATCH: list[str] = []


def release(spark: SparkSession) -> None:
    """Remove all scratch tables and checkpoints made so far. For use between queries, once their results are written:
    a DataFrame that reads them can't be computed again."""
    while _SCRATCH:
        removed(spark, _SCRATCH.pop())
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not folder.isEmpty():
        system, place = _folder(spark, folder.get())
        for entry in system.listStatus(place) if system.exists(place) else []:
            system.delete(entry.getPath(), True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; later reads prune its columns and keep statistics."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """The state of a loop: each round's table is written to the shared folder, and the one before the last is removed."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.label = spark, label
        self.paths: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, self.label)
        df.write.mode("overwrite").parquet(path)
        self.paths.append(path)
        if len(self.paths) > 2:
            removed(self.spark, self.paths.pop(0))
        return self.spark.read.schema(df.schema).parquet(path)

    def observed(self, df: DataFrame, *metrics: Column) -> tuple[DataFrame, dict]:
        """The kept table, and aggregates of it that are taken while it is written."""
        seen = Observation(f"{self.label}-{uuid.uuid4().hex}")
        return self.keep(df.observe(seen, *metrics)), seen.get


def few(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows; else as it is, for a shuffled or partitioned join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
