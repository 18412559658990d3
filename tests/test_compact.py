import os
import time

import pytest

from waymill.streaming.compact import RECORD, Sealed, binary_files, compact, seal, sidecar_records, table_of_files

FILES = "file_id bigint, file_path string, n_bytes bigint, body string, modified_at timestamp_ntz"
NAME = "/a/m1/route_m1_walk_{}_start_end{}"


def records(spark, bodies):
    rows = [(k, path, len(body or ""), body, None) for k, (path, body) in enumerate(bodies)]
    return {tuple(r) for r in sidecar_records(spark.createDataFrame(rows, FILES)).collect()}


def test_text_forms(spark):
    body = "\ufeffcoordinates;geometry\r\n Origin ;POINT (1.00 2.00)\r\ndestination;\"SRID=28992;point Z (3 4 0)\"\rPOINT(5.005e1 6);ORIGIN_NODE\n\"POINT ( 7.5   8 )\"; destination_node \n"
    assert records(spark, [(NAME.format("007", ".csv"), body)]) == {
        ("m1", 7, "origin", 100, 200), ("m1", 7, "destination", 300, 400), ("m1", 7, "origin_node", 5005, 600), ("m1", 7, "destination_node", 750, 800),
    }


@pytest.mark.parametrize("line", ["origin;", "origin;POINT (1 2", "origin;POINT (1.", "via;POINT (1 2)", "# note", ";;", "origin;POINT EMPTY", "origin;POINT (nan nan)", "origin;POINT (1)", "ori", "origin;SRID=28992;POINT (1 2)", "", "origin;POINT (1 2 3 4 5)"])
def test_unusable_lines(spark, line):
    assert records(spark, [(NAME.format(1, ".csv"), line), (NAME.format(2, ".csv"), "coordinates;geometry\n" + line + "\n")]) == set()


def test_names_and_nulls(spark):
    line = "origin;POINT (1 2)"
    bodies = [(NAME.format("0012", ".csv.bak"), line), (NAME.format(13, " (2).csv"), line), (NAME.format(14, ".part2.CSV"), line), (NAME.format(15, ".csv"), None), (NAME.format(16, ".csv"), ""), ("/a/other.csv", line), (None, line), ("", line)]
    assert {r[1] for r in records(spark, bodies)} == {12, 13, 14}


def test_very_long_body(spark):
    body = "\n".join(f"origin;POINT ({k} {k})" for k in range(20_000)) + "\n" + "x" * 300_000 + ";" * 1000
    assert len(records(spark, [(NAME.format(1, ".csv"), body)])) == 20_000


def write(spark, path, rows, mode="append"):
    spark.createDataFrame(rows, FILES).coalesce(1).write.mode(mode).parquet(path)


def batches(work):
    """How many batches the stream has committed."""
    return len([p for p in (work / "checkpoint/commits").iterdir() if p.name.isdigit()])


def test_stream_takes_each_file_once_and_retries_replace(spark, tmp_path):
    source, work = str(tmp_path / "in.parquet"), str(tmp_path / "work")
    write(spark, source, [(1, NAME.format(1, ".csv"), 1, "origin;POINT (1 2)", None), (2, NAME.format(1, ".csv.bak"), 1, "origin;POINT (1.000 2)", None)])
    assert compact(spark, table_of_files(source), workdir=work, max_bytes=1).count() == 1
    write(spark, source, [(3, NAME.format(2, ".csv"), 1, "origin;POINT (3 4)\norigin;POINT (3 4)", None)])
    write(spark, source, [(4, NAME.format(3, ".csv"), 1, None, None)])
    sealed = compact(spark, table_of_files(source), workdir=work, max_bytes=1)
    assert {tuple(r) for r in sealed.collect()} == {("m1", 1, "origin", 100, 200), ("m1", 2, "origin", 300, 400)}
    assert batches(tmp_path / "work") == 3  # one file each
    assert not list((tmp_path / "work/landing").iterdir())  # sealed batches are removed
    assert compact(spark, table_of_files(source), workdir=work).count() == 2 and batches(tmp_path / "work") == 3
    # a batch whose commit got lost runs again under its number and replaces its folder
    for name in ("2", ".2.crc"):
        (tmp_path / "work/checkpoint/commits" / name).unlink(missing_ok=True)
    assert compact(spark, table_of_files(source), workdir=work).count() == 2 and batches(tmp_path / "work") == 3


def parts(folder):
    return sorted(p.name for p in folder.glob("part-*"))


def test_sealing_is_incremental_and_survives_breaks(spark, tmp_path, monkeypatch):
    landing, target = str(tmp_path / "landing"), tmp_path / "sealed"
    land = lambda k, *numbers: spark.createDataFrame([("m", n, "origin", None, 0) for n in numbers], RECORD).write.mode("overwrite").parquet(f"{landing}/batch={k}")
    sealed = lambda **o: sorted(r["route_no"] for r in seal(spark, landing, str(target), RECORD, **o).collect())
    assert sealed() == []
    land(0, 1, 1, 2)
    assert sealed() == [1, 2] and parts(target) == ["part-1"]
    land(1, 2, 3)
    assert sealed(small_part=0) == [1, 2, 3] and parts(target) == ["part-1", "part-2"]  # a large part stays, its records count once
    assert spark.read.parquet(str(target / "part-2")).count() == 1
    land(2, 3, 4)
    assert sealed() == [1, 2, 3, 4] and parts(target) == ["part-3"]  # small parts are taken in
    land(0, 9)  # a batch that is sealed already, landed by a late retry
    assert sealed() == [1, 2, 3, 4]
    land(3, 5)
    with monkeypatch.context() as broken:  # a break before the manifest: nothing is seen of the new part
        broken.setattr(Sealed, "commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            sealed()
    assert Sealed(spark, str(target)).state()[1] == ["part-3"] and parts(target) == ["part-3", "part-4"]
    with monkeypatch.context() as broken:  # a break after it: the next run removes what is left
        broken.setattr("waymill.streaming.compact.removed", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            sealed()
    assert sealed() == [1, 2, 3, 4, 5] and parts(target) == ["part-4"] and not list((tmp_path / "landing").iterdir())


def test_empty_table_and_single_file(spark, tmp_path):
    write(spark, str(tmp_path / "none.parquet"), [])
    empty = compact(spark, table_of_files(str(tmp_path / "none.parquet")))
    assert empty.count() == 0 and empty.schema == RECORD
    write(spark, str(tmp_path / "x"), [(1, NAME.format(1, ".csv"), 1, "origin;POINT (1 2)", None)])
    part = next((tmp_path / "x").glob("part-*.parquet"))
    part.rename(tmp_path / "one.parquet")
    assert compact(spark, table_of_files(str(tmp_path / "one.parquet"))).count() == 1


def test_folder_of_tiny_files(spark, tmp_path):
    for k in range(30):
        folder = tmp_path / "tiny" / f"run_{k % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"route_m9_walk_{k}_start_end.csv").write_text(f"\ufefforigin;POINT ({k} 1)\ndestination;POINT ({k} 2)\n", encoding="utf-8")
    sealed = compact(spark, binary_files(str(tmp_path / "tiny"), "*.csv"), workdir=str(tmp_path / "w"))
    assert sealed.count() == 60
    assert len(list((tmp_path / "w/sealed").glob("part-*/part-*"))) <= 4


@pytest.mark.parametrize("kind", ["folder", "table", "one file of a table"])
def test_late_files_of_old_modification_time_are_taken(spark, tmp_path, kind):
    place, work, now = tmp_path / "in", str(tmp_path / "work"), time.time()
    place.mkdir()

    def deliver(number, days):
        line = f"origin;POINT ({number} 1)"
        if kind == "folder":
            file = place / f"route_m1_walk_{number}_start_end.csv"
            file.write_text(line)
        else:
            write(spark, str(tmp_path / f"one_{number}"), [(number, NAME.format(number, ".csv"), 1, line, None)])
            file = place / f"part-{number}.parquet"
            next((tmp_path / f"one_{number}").glob("part-*.parquet")).rename(file)
        os.utime(file, (now - days * 86400, now - days * 86400))

    def taken():
        if kind == "folder":
            source = binary_files(str(place), "*.csv")
        elif kind == "table":
            source = table_of_files(str(place))
        else:  # the stream of a single file watches its folder for that name
            source = table_of_files(str(place / f"part-{newest}.parquet"))
        return {r["route_no"] for r in compact(spark, source, workdir=work).collect()}

    newest = 1
    deliver(1, 0)
    deliver(2, 30)
    assert taken() == ({1} if kind.startswith("one") else {1, 2})
    newest = 5
    for number, days in ((3, 0), (4, 6), (5, 30), (6, 20_000)):
        deliver(number, days)
    assert taken() == ({1, 5} if kind.startswith("one") else {1, 2, 3, 4, 5, 6})


def test_batches_are_bounded_without_a_given_bound(spark, tmp_path):
    folder, each = tmp_path / "tiny", 300
    folder.mkdir()
    for k in range(6):
        (folder / f"route_m1_walk_{k}_start_end.csv").write_text(f"origin;POINT ({k} 1)".ljust(each))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", f"{2 * each // spark.sparkContext.defaultParallelism}b")  # a wave is two files
        sealed = compact(spark, binary_files(str(folder), "*.csv"), workdir=str(tmp_path / "w"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert sorted(r["route_no"] for r in sealed.collect()) == list(range(6))
    assert batches(tmp_path / "w") == 3
