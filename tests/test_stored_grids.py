"""Grid files as a data source, the store's maintenance, steps over stored grids, lookup order and cache."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoquill.plans import stored
from geoquill.plans.language import PipelineError
from geoquill.plans.pipeline import Context, Pipeline
from geoquill.sources import gridcache, griddata, gridfiles, gridstore, gridwrite

RAD = math.pi / 180


def wavy(rows, cols, north, west, step, name, bands=2, amplitude=30.0):
    """Shifts of up to half a minute that differ from cell to cell."""
    lat, lon = np.meshgrid(north - step * np.arange(rows), west + step * np.arange(cols), indexing="ij")
    nodes = np.stack([amplitude * np.sin(lat * 1.3 + k) * np.cos(lon * 0.9 - k) for k in range(bands)], axis=-1)
    return gridstore.as_grid(nodes, north, west, step, name, {1: "geoid", 2: "horizontal", 3: "deformation"}[bands])


@pytest.fixture(scope="module")
def grids():
    base = wavy(17, 33, 58.0, 8.0, 0.25, "base")
    base.parts.append(wavy(9, 9, 57.0, 10.0, 0.0625, "fine", amplitude=60.0))
    return {"base": base, "wide": wavy(9, 21, 60.0, 0.0, 1.0, "wide"), "geoid": wavy(17, 33, 58.0, 8.0, 0.25, "geoid", 1), "velocity": wavy(17, 33, 58.0, 8.0, 0.25, "velocity", 3)}


@pytest.fixture(scope="module")
def store(spark, grids, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("grids") / "store")
    for g in grids.values():
        gridstore.add(spark, g, path)
    return path


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    lon, lat = np.concatenate((rng.uniform(7.5, 16.5, 400), rng.uniform(9.9, 10.7, 150), [10.0, 10.5, 12.0, 16.0, 8.0, 16.05, 0.0])), np.concatenate((rng.uniform(53.5, 58.5, 400), rng.uniform(56.4, 57.1, 150), [57.0, 56.5, 55.0, 54.0, 58.0, 57.3, 0.0]))
    rows = [(k, float(a * RAD), float(b * RAD), float(k % 50), 2000.0 + k % 20) for k, (a, b) in enumerate(zip(lon, lat, strict=True))]
    rows += [(9000, None, 0.9, 1.0, 2001.0), (9001, math.nan, 0.9, 1.0, 2001.0)]
    return spark.createDataFrame(rows, "k int, lon double, lat double, h double, year double").repartition(3)


def both(points, grids, store, text, direction="fwd", at=("lon", "lat", "h", "year")):
    memory, on_store = Context(), Context(store=store)
    for name, g in grids.items():
        memory.register_grid(name, g)
    return [c.pipeline(text).transform(points, *at, direction=direction).orderBy("k").toPandas() for c in (memory, on_store)]


@pytest.mark.parametrize("text,direction", [
    ("gridshift grids=base", "fwd"), ("gridshift grids=base", "inv"), ("gridshift grids=base,wide", "inv"), ("gridshift grids=@none,wide,base,@null", "fwd"), ("gridshift grids=base,@null", "fwd"),
    ("gridshift grids=geoid", "fwd"), ("gridshift grids=geoid,@null", "inv"), ("noop | stack push=2 | gridshift grids=base | addone | stack pop=3 | geodesic", "fwd"),
    ("gridshift inv grids=wide | gridshift grids=base | tmerc lon_0=12", "fwd"),
])
def test_stored_shifts_equal_those_on_arrays(points, grids, store, text, direction):
    a, b = both(points, grids, store, text, direction)
    assert (a["ok"] == b["ok"]).all() and 0 < a["ok"].sum()
    for c in "xyzt":
        assert np.allclose(a[c], b[c], rtol=0, atol=1e-12 if "tmerc" not in text and "geodesic" not in text else 1e-5, equal_nan=True), c


@pytest.mark.parametrize("text", ["cart | deformation grids=velocity t_epoch=2010", "cart | deformation inv grids=velocity dt=7", "cart | deformation raw grids=velocity dt=7"])
def test_stored_velocities(points, grids, store, text):
    a, b = both(points, grids, store, text)
    assert (a["ok"] == b["ok"]).all() and 0 < a["ok"].sum()
    assert np.allclose(a[["x", "y", "z"]], b[["x", "y", "z"]], rtol=0, atol=1e-8, equal_nan=True)


def test_stored_deflections(points, grids, store):
    degrees = points.withColumns({"lon": F.degrees("lon"), "lat": F.degrees("lat")})
    a, b = both(degrees, grids, store, "deflection grids=geoid", at=("lat", "lon"))
    assert (a["ok"] == b["ok"]).all() and np.allclose(a[["x", "y"]], b[["x", "y"]], atol=1e-6, equal_nan=True)


def test_steps_and_counts_over_a_store(points, store):
    c = Context(store=store)
    p = c.pipeline("addone | gridshift grids=base | addone inv")
    counts = p.success_counts(points.withColumn("lon", F.col("lon") - 1), "lon", "lat").first()
    assert counts["n"] == points.count() and counts["successes"] == counts["ok_2"] == counts["ok_3"] < counts["n"] and counts["ok_1"] == counts["n"] - 2
    with pytest.raises(PipelineError):
        p.arrays(0.2, 0.9)
    with pytest.raises(PipelineError):
        c.pipeline("deflection inv grids=geoid")
    with pytest.raises(PipelineError):
        c.pipeline("gridshift grids=nowhere")


def test_only_moving_points_join_again(points, grids, store, monkeypatch):
    sizes = []
    real = stored.Tables.met
    monkeypatch.setattr(stored.Tables, "met", lambda self, df, x, y: (sizes.append(df.count()), real(self, df, x, y))[1])
    Context(store=store).pipeline("gridshift inv grids=base").transform(points, "lon", "lat").count()
    assert sizes[0] == points.count() and len(sizes) > 1 and sizes[1] < 0.2 * sizes[0] and sizes == sorted(sizes, reverse=True)


@pytest.mark.parametrize("end", ["gsb", "gtx", "gri", "gsa", "tif"])
def test_files_come_in_by_rows(spark, tmp_path, grids, end):
    grid = grids["geoid" if end in ("gtx",) else "base" if end == "gsb" else "wide"]
    path = gridwrite.write(spark, grid, str(tmp_path / f"g.{end}"))
    spark.dataSource.register(griddata.GridSource)
    source = spark.read.format(griddata.FORMAT).option("cells", "40").option("name", grid.name).load(path)
    assert source.rdd.getNumPartitions() > 3
    got, want = (d.orderBy("grid_id", "part", "row", "col").toPandas() for d in (source, gridstore.cells(spark, grid)))
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        assert np.allclose(np.stack(got[c]), np.stack(want[c]), atol=1e-6, equal_nan=True) if got[c].dtype != object or c in ("nw", "ne", "sw", "se") else (got[c] == want[c]).all(), c
    # a store that only Spark reads: whole, in a task
    monkey = pytest.MonkeyPatch()
    monkey.setattr(griddata, "ranged", lambda p: False)
    assert griddata.rows_of(spark, path, grid.name).count() == len(want)
    heads = [tuple(r) for r in griddata.rows_of(spark, path, grid.name, "heads").collect()]
    monkey.undo()
    assert heads == [tuple(r) for r in griddata.rows_of(spark, path, grid.name, "heads").collect()]
    store = str(tmp_path / "store")
    gridstore.add_file(spark, path, store, grid.name)
    assert gridstore.known(spark, store).count() == 1 + len(grid.parts)


def test_rows_of_a_large_file_are_read_by_place(spark, tmp_path):
    """A band reads its rows only: a file whose other rows were cut off gives them just the same."""
    grid = wavy(401, 101, 60.0, 0.0, 0.05, "g")
    data = gridwrite.ntv2(grid)
    whole = gridfiles.heads("g.gsb", data)[0]
    rows = whole.nodes(390, 401)  # the southernmost stand first
    cut = data[: 352 + 16 * 101 * 11]
    assert np.array_equal(gridfiles.heads("g.gsb", cut)[0].nodes(390, 401), rows)
    with pytest.raises(ValueError):
        gridfiles.heads("g.gsb", cut)[0].nodes(0, 5)


def test_store_is_mended_and_replaced(spark, tmp_path):
    path = str(tmp_path / "store")
    for name in ("a", "b", "a b/c"):
        gridstore.add(spark, wavy(5, 5, 60.0, 0.0, 1.0, name), path)
    gridstore.add(spark, wavy(4, 4, 60.0, 0.0, 1.0, "a"), path)  # in place of the other
    count = lambda: {r["grid_id"]: r["cells"] for r in gridstore.names(spark, path).collect()}
    assert count() == {"a": 9, "b": 16, "a b/c": 16}
    gridstore.vacuum(spark, path)
    assert count() == {"a": 9, "b": 16, "a b/c": 16} and {r["grid_id"] for r in gridstore.paths(spark, path).collect()} == {"a", "b", "a b/c"}
    assert gridstore.paths(spark, path).count() == 3
    os.rename(f"{path}/grid_id=b", f"{path}/_gone-grid_id~b")  # a driver lost in the middle
    assert set(count()) == {"a", "a b/c"}
    gridstore.recover(spark, path)
    assert set(count()) == {"a", "b", "a b/c"}
    assert gridstore.remove(spark, "a b/c", path) and not gridstore.remove(spark, "a b/c", path)
    assert {r["grid_id"] for r in gridstore.known(spark, path).collect()} == {"a", "b"}


def test_names_are_looked_up_in_order(spark, tmp_path, store, grids):
    (tmp_path / "grids").mkdir()
    path = tmp_path / "grids" / "file.gsb"
    path.write_bytes(gridwrite.ntv2(grids["wide"]))
    (tmp_path / "base").write_bytes(gridwrite.gravsoft(wavy(5, 9, 58.0, 8.0, 1.0, "x", amplitude=1.0)))
    c = Context([str(tmp_path)], store)
    assert isinstance(c.grid("file.gsb"), gridcache.InFile) and isinstance(c.grid("base"), gridcache.InFile) and isinstance(c.grid("wide"), stored.Stored) and c.grid("none") is None
    c.register_grid("base", grids["base"])
    assert isinstance(c.grid("base"), gridcache.Sent) and c.grid("base") is c.grid("base")
    at = c.pipeline("gridshift grids=file.gsb").arrays(12.3 * RAD, 55.6 * RAD)
    want = grids["wide"].at(12.3 * RAD, 55.6 * RAD)
    assert at.x[0] == pytest.approx(12.3 * RAD + want[0] * RAD / 3600, abs=1e-11)
    # a step over a stored grid takes the others along
    df = spark.createDataFrame([(12.3 * RAD, 55.6 * RAD), (1.5 * RAD, 59.5 * RAD)], "lon double, lat double")
    out = Context([str(tmp_path)], store).pipeline("gridshift grids=base,file.gsb,velocity").transform(df, "lon", "lat").collect()
    assert all(r["ok"] for r in out) and abs(out[0]["x"] / RAD - 12.3) * 3600 < 1.01


def test_a_grid_is_sent_and_decoded_once(spark, tmp_path, grids):
    (tmp_path / "file.gsb").write_bytes(gridwrite.ntv2(grids["wide"]))
    c = Context([str(tmp_path)])
    c.register_grid("base", grids["base"])
    df = spark.range(20).select((F.lit(12 * RAD) + F.col("id") * 1e-4).alias("lon"), F.lit(56 * RAD).alias("lat")).coalesce(1)

    @F.udf("struct<pid:long,n:long>")
    def count(_):
        return os.getpid(), gridcache.decoded()

    def seen():
        return spark.range(1).coalesce(1).select(count("id").alias("c")).first()["c"]

    texts = ("gridshift grids=base", "gridshift inv grids=base", "gridshift grids=file.gsb,base", "noop | gridshift grids=file.gsb | addone")
    before = seen()
    for text in texts:
        assert c.pipeline(text).transform(df, "lon", "lat").filter("ok").count() == 20
    after = seen()
    assert before["pid"] != after["pid"] or after["n"] - before["n"] <= 2
    held = c.grid("base")
    assert held.__reduce__()[1][1] is held.__reduce__()[1][1]  # one broadcast for all plans
    gridcache.clear()
    assert c.pipeline(texts[0]).transform(df, "lon", "lat").filter("ok").count() == 20


def test_the_cache_is_bounded_and_cleared():
    gridcache.clear()
    size = wavy(101, 101, 60.0, 0.0, 0.1, "g").nodes.nbytes
    old = gridcache._state["limit"]
    gridcache.limit(int(2.5 * size))
    try:
        start = gridcache.decoded()
        make = lambda: wavy(101, 101, 60.0, 0.0, 0.1, "g")
        for key in ("a", "b", "a", "c", "a", "b"):
            gridcache.get(key, make)
        assert gridcache.decoded() - start == 4  # b went for c
        gridcache.clear()
        gridcache.get("a", make)
        assert gridcache.decoded() - start == 5
    finally:
        gridcache.limit(old)


def test_pipelines_on_streams_over_a_store(spark, points, store, tmp_path):
    points.write.parquet(str(tmp_path / "in"))
    p = Context(store=store).pipeline("gridshift grids=base | tmerc lon_0=12")
    stream = p.transform(spark.readStream.schema(points.schema).parquet(str(tmp_path / "in")), "lon", "lat")
    query = stream.writeStream.format("memory").queryName("stored").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("stored").filter("ok").count() == p.transform(points, "lon", "lat").filter("ok").count() > 0
    with pytest.raises(ValueError):
        Context(store=store).pipeline("gridshift inv grids=base").transform(spark.readStream.schema(points.schema).parquet(str(tmp_path / "in")), "lon", "lat")
    assert Pipeline("noop").transform(points, "lon", "lat").count() == points.count()
