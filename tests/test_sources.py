import json
import os
import pickle
import sqlite3
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymill.sources import files, geopackage


def test_metadata_forms(spark, tmp_path):
    (tmp_path / "flat.json").write_text(json.dumps({"CRS": "a", "CRS_map": "b", "area_choice": "c", "my_areas": []}))
    (tmp_path / "deep.json").write_text(json.dumps({"map": {"CRS": "x", "CRS_map": "y"}, "user_model": {"max_curb_height": 0.1}}, indent=2))
    assert tuple(files.read_metadata(spark, str(tmp_path / "flat.json")).first())[:4] == ("a", "b", "c", [])
    deep = files.read_metadata(spark, str(tmp_path / "deep.json")).first()
    assert (deep["crs"], deep["user_model"]["max_curb_height"]) == ("x", 0.1)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.read_metadata(spark, str(tmp_path / "none.json")).collect()


def test_sidecars_roundtrip(spark, tmp_path):
    for k in (0, 12):
        (tmp_path / f"route_demo_walk_{k}_start_end.csv").write_text("coordinates;geometry\norigin;POINT (1 2)\n")
    got = files.read_sidecars(spark, str(tmp_path / "*.csv"))
    assert {tuple(r) for r in got.collect()} == {("0", "origin", "POINT (1 2)"), ("12", "origin", "POINT (1 2)")}
    files.write_sidecars(got, str(tmp_path / "out"))
    assert files.read_sidecars(spark, str(tmp_path / "out")).count() == 2


@pytest.mark.parametrize(("name", "number"), [("p_route_demo_walk_7.gpkg", "7"), ("route_demo_walk_012_start_end.csv", "012"), ("route.gpkg", None), ("", None)])
def test_route_number(spark, name, number):
    assert spark.createDataFrame([(name,)], "n string").select(files.route_number(F.col("n"))).first()[0] == number


def test_operations(spark, tmp_path):
    ops = [["add", [5, "POINT (1 2)"], 3.5, "success"], ["drop", [6, "POINT (3 4)"], "x", "failed"], ["move", ["k", "LINESTRING (0 0, 1 1)"], None, "success"]]
    (tmp_path / "route_op_a_1.json").write_text(json.dumps(ops))
    got = files.read_operations(spark, str(tmp_path)).orderBy("step").select("op", "key", "geometry", "value").collect()
    assert [tuple(r) for r in got] == [("add", "5", "POINT (1 2)", "3.5"), ("move", "k", "LINESTRING (0 0, 1 1)", None)]
    assert files.parse_operations(json.dumps(ops))[1][0] == "move"
    table = spark.createDataFrame([("r", 0, "add", "5", "POINT (1 2)", 3.5, "success"), ("r", 1, "x", "6", "g", 1.0, "failed")], "route_id string, step int, op string, key string, geometry string, value double, status string")
    assert json.loads(files.operation_lists(table, "route_id").first()["ops"]) == [["add", ["5", "POINT (1 2)"], "3.5", "success"]]
    lists = files.operation_lists(table, "route_id")
    files.write_operations(lists, str(tmp_path / "table"))
    assert [tuple(r) for r in files.read_operation_table(spark, str(tmp_path / "table"), "route_id").collect()] == [("r", 0, "add", "5", "POINT (1 2)", "3.5")]


def test_tables_splits_and_validity(spark, tmp_path):
    df = spark.createDataFrame([("r", "m", "LINESTRING (0 0, 1 1)", "train"), ("q", "m", None, "val")], "route_id string, map_id string, geometry string, split string")
    files.write_tables(str(tmp_path), {"a": df, "b": df.limit(0)})
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2 and spark.read.parquet(str(tmp_path / "b")).count() == 0
    files.write_splits(df, str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").glob("split=*")) == ["split=train", "split=val"]
    files.write_routes(df, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2
    assert [r["route_id"] for r in files.valid_routes(df).collect()] == ["r"] and [r["route_id"] for r in files.invalid_routes(df).collect()] == ["q"]


def blob(points, order="<", z=False, envelope=False):
    flat = [v for p in points for v in (*p, 9.0)[: 3 if z else 2]]
    wkb = struct.pack(order + "BII", 1 if order == "<" else 0, 1002 if z else 2, len(points)) + struct.pack(f"{order}{len(flat)}d", *flat)
    return b"GP" + bytes([0, 3 if envelope else 1]) + struct.pack("<i", 28992) + (struct.pack("<4d", 0, 0, 0, 0) if envelope else b"") + wkb


def test_geopackage(spark, tmp_path):
    for k, shapes in enumerate([[blob([(0.0, 0.5), (1.0, 2.0)]), blob([(0.0, 0.0), (1.0, 1.0)], ">", True, True), None], [b"GP\x00\x11\x00\x00\x00\x00"]]):
        with sqlite3.connect(tmp_path / f"p_route_x_{k}.gpkg") as db:
            db.execute("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT)")
            db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
            db.execute("INSERT INTO gpkg_contents VALUES ('r', 'features')")
            db.execute("INSERT INTO gpkg_geometry_columns VALUES ('r', 'shape')")
            db.execute("CREATE TABLE r (edge_id INTEGER, length REAL, shape BLOB)")
            db.executemany("INSERT INTO r VALUES (?, 1.5, ?)", list(enumerate(shapes)))
    spark.dataSource.register(geopackage.GeoPackageSource)
    df = spark.read.format("geopackage").schema("edge_id bigint, length double, geometry string, missing string, source_file string").load(str(tmp_path))
    got = sorted((files_name(r["source_file"]), r["edge_id"], r["length"], r["geometry"], r["missing"]) for r in df.collect())
    assert got == [
        ("p_route_x_0.gpkg", 0, 1.5, "LINESTRING (0.0 0.5, 1.0 2.0)", None), ("p_route_x_0.gpkg", 1, 1.5, "LINESTRING (0.0 0.0, 1.0 1.0)", None),
        ("p_route_x_0.gpkg", 2, 1.5, None, None), ("p_route_x_1.gpkg", 0, 1.5, None, None),
    ]


def files_name(path):
    return path.rsplit("/", 1)[-1]


def test_point_and_polygon_blobs():
    assert geopackage.wkb_to_wkt(struct.pack("<BI2d", 1, 1, 3.0, 4.0)) == "POINT (3.0 4.0)"
    ring = [0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 0.0]
    assert geopackage.wkb_to_wkt(struct.pack("<BIII8d", 1, 3, 1, 4, *ring)) == "POLYGON ((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 0.0))"
    assert geopackage.wkb_to_wkt(b"") is None


def test_pickled_tables(spark, tmp_path):
    pd.DataFrame({"route_id": ["a", "b"], "step_id": [0, 1], "feature_vec": [[1.0, 2.0], [3.0]]}).to_pickle(tmp_path / "one.df")
    pd.DataFrame({"route_id": ["c"], "extra": [1]}).to_pickle(tmp_path / "two.df")
    got = files.read_pickled_tables(spark, str(tmp_path), "route_id string, step_id bigint, feature_vec array<double>")
    assert sorted(map(tuple, got.collect())) == [("a", 0, [1.0, 2.0]), ("b", 1, [3.0]), ("c", None, None)]
    (tmp_path / "bad.df").write_bytes(pickle.dumps(os.getcwd))
    with pytest.raises(Exception, match="no part of a table"):
        files.read_pickled_tables(spark, str(tmp_path), "route_id string", glob="bad.df").collect()


def test_geopackages_of_any_file_system(spark, tmp_path):
    for k, line in enumerate(([(0, 0), (1, 2)], [(3, 3), (4, 4), (5, 5)])):
        with sqlite3.connect(tmp_path / f"p_route_demo_{k}.gpkg") as db:
            db.execute("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT)")
            db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
            db.execute("INSERT INTO gpkg_contents VALUES ('route', 'features')")
            db.execute("INSERT INTO gpkg_geometry_columns VALUES ('route', 'shape')")
            db.execute("CREATE TABLE route (edge_id INTEGER, shape BLOB, length REAL)")
            db.execute("INSERT INTO route VALUES (?, ?, ?)", (k, blob(line), 2.5))
        db.close()
    df = geopackage.read_geopackages(spark, str(tmp_path), "edge_id bigint, geometry string, length double, missing string, source_file string")
    assert [(r["edge_id"], r["geometry"], r["length"], r["missing"], r["source_file"].endswith(f"_{r['edge_id']}.gpkg")) for r in df.orderBy("edge_id").collect()] == [
        (0, "LINESTRING (0.0 0.0, 1.0 2.0)", 2.5, None, True), (1, "LINESTRING (3.0 3.0, 4.0 4.0, 5.0 5.0)", 2.5, None, True),
    ]
    assert geopackage.list_files(spark, str(tmp_path), "*.gpkg").count() == 2
    assert geopackage.read_geopackages(spark, str(tmp_path), "edge_id bigint", glob="*.none").collect() == []
