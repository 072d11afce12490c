"""Grids, files, streams, statistics and the registered queries, on Spark."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from geoquill import queries
from geoquill.functions import geodesics
from geoquill.functions.ellipsoid import Ellipsoid
from geoquill.plans.factors import factors
from geoquill.plans.language import PipelineError
from geoquill.plans.pipeline import Context, Pipeline
from geoquill.sources import gridfiles, gridstore, text
from geoquill.streaming import centroids

RAD = math.pi / 180
DATUM = "54. 58. 8. 16. 1. 1.\n" + "\n".join(" ".join(f"{lat}. {lon}." for lon in range(8, 17)) for lat in range(58, 53, -1))
FINER = DATUM + "\n# --- finer\n55 56 10 12 1 1\n" + " ".join(f"{lat + 0.5} {lon + 0.5}" for lat in (56, 55) for lon in (10, 11, 12))
GEOID = "54 58 8 16 1 1\n" + "\n".join(" ".join(str(float(lat)) for _ in range(9)) for lat in range(58, 53, -1))


@pytest.fixture
def context():
    c = Context()
    for name, data in (("datum", DATUM), ("finer", FINER), ("geoid", GEOID)):
        c.register_grid(name, gridfiles.parse(name, data.encode()))
    return c


def test_gridshift(context):
    out = context.pipeline("gridshift grids=datum").arrays(12 * RAD, 55 * RAD)
    assert (out.y[0] / RAD, out.x[0] / RAD) == (pytest.approx(55.015278, abs=1e-6), pytest.approx(12.003333, abs=1e-6))
    p = context.pipeline("gridshift grids=datum")
    x, y = np.linspace(8.1, 15.9, 40) * RAD, np.linspace(54.1, 57.9, 40) * RAD
    there = p.arrays(x, y)
    back = p.arrays(there.x, there.y, direction="inv")
    assert np.abs(back.x - x).max() < 1e-11 and np.abs(back.y - y).max() < 1e-11
    assert context.pipeline("gridshift grids=geoid").arrays(12 * RAD, 55.5 * RAD, 100.0).z[0] == pytest.approx(44.5)
    assert not context.pipeline("gridshift grids=datum").arrays(0.0, 0.0).ok[0]
    assert context.pipeline("gridshift grids=datum,@null").arrays(0.0, 0.0).ok[0]
    assert context.pipeline("gridshift grids=@missing,datum").grid_names() == ["@missing", "datum"]
    half = context.pipeline("gridshift grids=datum").arrays(12 * RAD, 58.4 * RAD)
    assert half.ok[0] and half.y[0] / RAD == pytest.approx(58.4 + 58.4 / 3600)
    with pytest.raises(PipelineError):
        context.pipeline("gridshift grids=missing")
    inner = context.pipeline("gridshift grids=finer").arrays(np.array([11, 12]) * RAD, np.array([55.5, 55.5]) * RAD)
    assert inner.y[0] / RAD == pytest.approx(55.5 + 56 / 3600) and inner.y[1] / RAD == pytest.approx(55.5 + 55.5 / 3600)  # the east border is the parent's


def test_grid_files():
    nodes = np.arange(12, dtype=">f4").reshape(3, 4)
    data = struct.pack(">4d2i", 50.0, 8.0, 0.5, 1.0, 3, 4) + nodes.tobytes()
    g = gridfiles.parse("h.gtx", data)
    assert g.at(9 * RAD, 50.5 * RAD)[0] == pytest.approx(5) and g.at(8 * RAD, 51 * RAD)[0] == pytest.approx(8)
    record = lambda k, v: k.ljust(8).encode() + v
    head = b"".join(record(k, v.ljust(8, b"\0")) for k, v in [("NUM_OREC", struct.pack("<i", 11)), ("NUM_SREC", struct.pack("<i", 11)), ("NUM_FILE", struct.pack("<i", 1)), *[(n, b"") for n in ("GS_TYPE", "VERSION", "SYSTEM_F", "SYSTEM_T", "MAJOR_F", "MINOR_F", "MAJOR_T", "MINOR_T")]])
    sub = b"".join(record(k, v) for k, v in [("SUB_NAME", b"A       "), ("PARENT", b"NONE    "), ("CREATED", b" " * 8), ("UPDATED", b" " * 8), *[(n, struct.pack("<d", v * 3600)) for n, v in (("S_LAT", 50), ("N_LAT", 52), ("E_LONG", -12), ("W_LONG", -10), ("LAT_INC", 1), ("LONG_INC", 1))], ("GS_COUNT", struct.pack("<i", 9) + b"\0" * 4)])
    # from the south-east: latitude shift is the latitude, longitude shift (west) minus the longitude
    values = np.array([[lat, -lon, 0, 0] for lat in (50, 51, 52) for lon in (12, 11, 10)], "<f4")
    g = gridfiles.parse("s.gsb", head + sub + values.tobytes())
    assert g.at(11 * RAD, 51 * RAD) == pytest.approx([11, 51]) and g.at(10.5 * RAD, 50.25 * RAD) == pytest.approx([10.5, 50.25])
    g = gridfiles.parse("a.gsa", b"DSAA\n3 2\n8 10\n50 51\n0 5\n0 1 2\n3 4 5\n")
    assert g.at(9 * RAD, 50 * RAD)[0] == pytest.approx(1) and g.at(10 * RAD, 51 * RAD)[0] == pytest.approx(5)
    with pytest.raises(ValueError):
        gridfiles.parse("x", b"54 58 8 16 1 1\n1 2 3")


def test_grid_store(spark, context, tmp_path):
    (tmp_path / "datum.txt").write_text(DATUM)
    grid = gridfiles.read(spark, str(tmp_path / "datum.txt"), "datum")
    gridstore.add(spark, grid, str(tmp_path / "store"))
    gridstore.add(spark, context.grids["geoid"], str(tmp_path / "store"))
    assert {(r["grid_id"], r["cells"]) for r in gridstore.names(spark, str(tmp_path / "store")).collect()} == {("datum", 32), ("geoid", 32)}
    table = spark.read.parquet(str(tmp_path / "store")).filter("grid_id = 'datum'")
    points = spark.createDataFrame([(1, 12.25 * RAD, 55.75 * RAD), (2, 16 * RAD, 54 * RAD), (3, 0.0, 0.0)], "i int, lon double, lat double")
    got = {r["i"]: (r["v1"], r["v2"]) for r in gridstore.lookup(points, table, "lon", "lat", 2).collect()}
    assert set(got) == {1, 2} and got[1] == pytest.approx((12.25, 55.75)) and got[2] == pytest.approx((16, 54))


def test_success_counts_and_roundtrip(spark, context):
    df = spark.createDataFrame([(12.0, 55.0), (0.0, 0.0), (None, 55.0)], "lon double, lat double")
    p = context.pipeline("gis:in | gridshift grids=datum")
    assert p.success_counts(df, "lon", "lat").first().asDict() == {"n": 3, "ok_1": 2, "ok_2": 1, "successes": 1}
    worst = Pipeline("gis:in | utm zone=32 | utm zone=32 inv | gis:out").roundtrip(df.limit(1), "lon", "lat").first()
    assert abs(worst["dx"]) < 1e-9 and abs(worst["dy"]) < 1e-9


def test_failures_are_nan_throughout(spark):
    df = spark.createDataFrame([(0.0, math.pi / 2 + 0.2, 7.0)], "lon double, lat double, h double")
    r = Pipeline("cea").transform(df, "lon", "lat", "h").first()
    assert r["ok"]
    r = Pipeline("cea inv").transform(spark.createDataFrame([(0.0, 1e8, 7.0)], "x double, y double, z double"), "x", "y", "z").first()
    assert not r["ok"] and all(math.isnan(r[c]) for c in "xyz")


def test_plans_shuffle_nothing(spark):
    df = spark.range(100).select((F.col("id") * 0.01).alias("lon"), F.lit(0.9).alias("lat"))
    plan = Pipeline("utm zone=32").transform(df, "lon", "lat")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_filters_on_results_stay_above_long_pipelines(spark):
    """They would be written out through every stage."""
    df = spark.range(100).select((F.col("id") * 0.01).alias("lon"), F.lit(0.9).alias("lat"))
    for condition in ("ok", "x > 0"):
        assert Pipeline("utm zone=32 | utm zone=32 inv | lcc lat_1=50").transform(df, "lon", "lat").filter(condition).count() > 0


def test_factors(spark):
    df = spark.createDataFrame([(9 * RAD, 55 * RAD), (12 * RAD, 55 * RAD)], "lon double, lat double")
    a, b = factors(df, Pipeline("utm zone=32"), "lon", "lat").orderBy("lon").collect()
    assert a["meridional_scale"] == pytest.approx(0.9996, abs=1e-7) and a["parallel_scale"] == pytest.approx(0.9996, abs=1e-7) and a["meridian_convergence"] == pytest.approx(0, abs=1e-6)
    assert b["meridional_scale"] == pytest.approx(b["parallel_scale"], abs=1e-7) and b["areal_scale"] == pytest.approx(b["parallel_scale"] ** 2, abs=1e-7) and b["meridian_parallel_angle"] == pytest.approx(90, abs=0.05)


def test_text(spark, tmp_path):
    (tmp_path / "in.txt").write_text("55 12 # here\n\n# nothing\n55:30:36N 12:15W 100 2020.5\nx 1\n-0:30 5\n")
    rows = sorted(text.read(spark, str(tmp_path / "in.txt")).collect(), key=str)
    assert len(rows) == 4
    by = {r["c2"]: r for r in rows}
    assert by[12.0]["c1"] == 55 and by[12.0]["c3"] == 0 and math.isnan(by[12.0]["c4"]) and by[12.0]["dimension"] == 2
    assert by[-12.25]["c1"] == pytest.approx(55.51) and by[-12.25]["c4"] == 2020.5 and math.isnan(by[1.0]["c1"]) and by[5.0]["c1"] == -0.5
    text.write(spark.createDataFrame([(1234.5, 2.0), (1.5, 2.0)], "a double, b double").coalesce(1), str(tmp_path / "out"), ["a", "b"])
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1.5000000000 2.0000000000", "1234.50000 2.00000"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{k % 5}:1{k % 6}:00", 0.1 + k * 1e-3, 0.9) for k in range(60)]
    events = spark.createDataFrame(rows, "ts string, lon double, lat double").withColumn("ts", F.to_timestamp("ts"))
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    query = centroids(source, Pipeline("utm zone=32"), "ts", "lon", "lat").writeStream.outputMode("complete").format("memory").queryName("centroids").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r["start"]: (round(r["x"], 6), r["n"]) for r in spark.table("centroids").collect()}
    expected = {r["start"]: (round(r["x"], 6), r["n"]) for r in centroids(events, Pipeline("utm zone=32"), "ts", "lon", "lat").collect()}
    assert got == expected and sum(n for _, n in got.values()) == 60
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.txt").write_text("55 12\n56 13\n")
    moved = Pipeline("geo:in | utm zone=32").transform(text.stream(spark, str(tmp_path / "lines")), "c1", "c2")
    query = moved.writeStream.format("memory").queryName("moved").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("moved").filter("ok").count() == 2


def test_entry_point():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(queries.oracle_sql()) <= set(queries.queries()) and len(queries.oracle_sql()) > 50


def test_store_of_several_grids(spark):
    flat = lambda value, rows=5, cols=5: np.full((rows, cols, 1), float(value))
    north = gridstore.as_grid(flat(1), 60.0, 0.0, 1.0, "north")
    north.parts.append(gridstore.as_grid(flat(2, 3, 3), 59.0, 1.0, 0.5, "fine"))
    north.parts.append(gridstore.as_grid(flat(4, 3, 3), 58.0, 2.0, 0.5, "fine"))  # another part of that name
    south = gridstore.as_grid(flat(3), 57.0, 3.0, 1.0, "south")
    table = gridstore.cells(spark, north).unionByName(gridstore.cells(spark, south))
    at = [(0.5, 59.5), (1.5, 58.5), (3.5, 56.5), (6.5, 53.5), (2.0, 58.5), (1.5, 59.0), (1.0, 58.0), (9.0, 59.0), (2.5, 57.5)]
    points = spark.createDataFrame([(i, *np.radians(p).tolist()) for i, p in enumerate(at)], "i long, lon double, lat double")
    found = lambda **k: {r["i"]: round(r["v1"], 9) for r in gridstore.lookup(points, table, "lon", "lat", 1, **k).collect()}
    assert found() == {0: 1, 1: 2, 2: 1, 3: 3, 4: 1, 5: 1, 6: 2, 8: 4}
    assert found(order=("south", "north")) == {0: 1, 1: 1, 2: 3, 3: 3, 4: 1, 5: 1, 6: 1, 8: 1}


def against_sql(spark, folder, query, **tables):
    """Rows of a query over small tables (rows by column names), and those of its SQL."""
    duckdb = pytest.importorskip("duckdb").connect()
    for name, columns in tables.items():
        spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} bigint" for c in columns)).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        duckdb.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    got = __spark_entry__.queries()[query](spark, str(folder))
    want = duckdb.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[query]})").fetchall()
    return sorted(map(tuple, got.collect())), sorted(want)


def test_half_a_turn_goes_the_way_of_sql(spark, tmp_path):
    # longitudes exactly half a turn apart: the azimuth over the pole is -180 or 180
    got, want = against_sql(spark, tmp_path, "geodesic_inverse", customer={"c_custkey": [18449, 7]}, supplier={"s_suppkey": [1887], "s_nationkey": [1]}, orders={"o_orderkey": [1, 2], "o_custkey": [18449, 7]}, lineitem={"l_orderkey": [1, 2], "l_suppkey": [1887, 1887]})
    assert len(want) == 2 and got == want and want[1][2] == -180.0
    lon1, lat1, lon2, lat2 = np.radians([-165.076, -63.282, 14.924, 57.419])
    assert np.degrees(geodesics.inverse(Ellipsoid.named("GRS80"), lon1, lat1, lon2, lat2)[0]) == pytest.approx(-180) and lon2 - lon1 == math.pi


def test_legs_that_begin_on_the_line_are_as_in_sql(spark, tmp_path):
    keys = [167018, 355309, 543600, 731891, 0, *(k for k in range(40_000) if 2 * (k * 7919 % 4001) == k * 104729 % 8001)]
    got, want = against_sql(spark, tmp_path, "segment_crossings", customer={"c_custkey": sorted(set(keys))})
    assert got == want and {r[1] for r in want} == {0, 1}
