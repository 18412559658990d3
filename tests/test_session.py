import subprocess
import sys
import time
from pathlib import Path
from types import SimpleNamespace

import pytest

from waymill import session


def test_a_cluster_needs_a_shared_folder():
    bare = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: bare), conf=bare)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(cluster)


def test_scratch_is_released(spark):
    place = Path(session.shared_dir(spark).removeprefix("file:"))
    files = lambda: {p for p in place.rglob("*") if p.is_file()}
    session.release(spark)
    before = files()
    session.checkpointed(spark.range(5)).count()
    session.written(spark.range(5), "some").count()
    assert files() > before
    session.release(spark)
    assert files() == before


def test_rounds_keep_two_tables(spark):
    rounds = session.Rounds(spark, "loop")
    df, first = spark.range(3), None
    for _ in range(4):
        df, first = rounds.observed(df, session.F.count(session.F.lit(1)).alias("n"))
    assert first == {"n": 3} and df.count() == 3 and len(rounds.paths) == 2


def test_few(spark):
    plan = lambda most: spark.range(10).crossJoin(session.few(spark.range(5), most))._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" in plan(5)


def test_scratch_goes_with_the_application(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from pyspark.sql import SparkSession
from waymill import session
spark = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", {str(tmp_path)!r}).config("spark.ui.enabled", "false").getOrCreate()
session.checkpointed(spark.range(5)), session.written(spark.range(5), "some")
print(len(__import__("os").listdir({str(tmp_path)!r})))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, check=True)
    assert int(done.stdout.split()[-1]) == 2
    for _ in range(50):  # the JVM ends a moment later
        if not list(tmp_path.iterdir()):
            return
        time.sleep(0.2)
    assert not list(tmp_path.iterdir())
