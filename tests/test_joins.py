"""As-of joins, neighbours, crossings, geodesics as expressions, derivatives and observed counts, against brute force."""

import bisect
import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from geoquill.functions import columns as geo
from geoquill.functions import geodesics
from geoquill.functions.dual import D, Dual
from geoquill.functions.ellipsoid import Ellipsoid
from geoquill.functions.mathx import Np
from geoquill.plans import recipes
from geoquill.plans.asof import as_of, helmert_at
from geoquill.plans.factors import NAMES, factors
from geoquill.plans.pipeline import Pipeline
from geoquill.plans.segments import crossings

GRS80 = Ellipsoid.named("GRS80")
DAY = datetime.datetime(2024, 1, 1)


# -- as of ------------------------------------------------------------------------------------


@pytest.mark.parametrize("rows", [1_000_000, 40])
@pytest.mark.parametrize("by", [True, False])
def test_as_of_against_search(spark, rows, by):
    rng = random.Random(6)
    at = lambda: DAY + datetime.timedelta(minutes=rng.randint(0, 300))
    left = [(k, rng.choice(["a", "a", "a", "b", "c", None]), at()) for k in range(400)] + [(900, "a", None)]
    right = [(rng.choice(["a", "a", "b", None]), at(), k) for k in range(60)] + [("a", None, 99)]
    a = spark.createDataFrame(left, "k int, found string, at timestamp").withColumnRenamed("found", "name")
    b = spark.createDataFrame(right, "name string, since timestamp, v int")
    got = {r["k"]: r["found"] and r["found"]["v"] for r in as_of(a, b, "at", "since", ["name"] if by else None, rows=rows).collect()}
    want = {}
    for k, name, t in left:
        known = sorted((s, n or "", v) for n, s, v in right if s is not None and (n == name and name is not None or not by))
        # of one time the greatest by the columns in order: name, then v
        known.sort(key=lambda x: (x[0], x[1] if not by else "", x[2]))
        i = bisect.bisect_right([s for s, *_ in known], t) if t is not None else 0
        want[k] = known[i - 1][2] if i else None
    if by:
        assert got == want
    else:  # rows without a name are greater or smaller than others as Spark orders nulls: compare the time alone
        when = {v: s for _, s, v in right}
        assert {k: v is not None and when[v] for k, v in got.items()} == {k: v is not None and when[v] for k, v in want.items()}


def test_as_of_without_rows(spark):
    a = spark.createDataFrame([(1, DAY)], "k int, at timestamp")
    none = spark.createDataFrame([], "at timestamp, v int")
    assert [tuple(r) for r in as_of(a, none, "at").collect()] == [(1, DAY, None)]
    assert as_of(a.filter("k > 1"), none, "at").collect() == []


def test_parameters_by_time(spark):
    rows = [(k, float(3_500_000 + k), 800_000.0, 5_200_000.0, 2000.0 + k) for k in range(6)]
    df = spark.createDataFrame(rows, "k int, x double, y double, z double, year double")
    sets = spark.createDataFrame([(2001.0, 10.0, 0.5, 2.0, 0.1, 2000.0), (2003.0, -5.0, 0.0, 0.0, 0.0, 2000.0)], "year double, x double, rz double, s double, dx double, t_epoch double")
    out = helmert_at(df, sets, "year", t="year", exact=True)
    got = {r["k"]: r for r in out.collect()}
    assert not got[0]["ok"] and math.isnan(got[0]["x"])
    for k, text in ((1, "x=10 rz=0.5 s=2 dx=0.1"), (2, "x=10 rz=0.5 s=2 dx=0.1"), (3, "x=-5"), (5, "x=-5")):
        want = Pipeline(f"helmert exact convention=coordinate_frame t_epoch=2000 {text}").arrays(*rows[k][1:])
        assert (got[k]["x"], got[k]["y"], got[k]["z"]) == pytest.approx((want.x[0], want.y[0], want.z[0]), abs=1e-6)
    with pytest.raises(ValueError):
        helmert_at(df, sets.drop("t_epoch"), "year", t="year")
    back = helmert_at(out.filter("ok"), sets, "year", t="year", exact=True, direction="inv").orderBy("k").collect()
    assert [r["x"] for r in back] == pytest.approx([r[1] for r in rows[1:]], abs=1e-6)


# -- neighbours -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def crowd():
    """Stations spread over the globe, crowded at one place, along the date line and at a pole."""
    rng = random.Random(9)
    out = [(k, rng.choice("abc"), math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for k in range(150)]
    out += [(200 + k, "a", 55.0 + rng.uniform(0, 1e-3), 12.0 + rng.uniform(0, 1e-3)) for k in range(80)]
    out += [(300 + k, "a", 10.0, 20.0) for k in range(60)]
    out += [(400 + k, "b", rng.uniform(-5, 5), 180 - rng.uniform(0, 0.1)) for k in range(20)] + [(500 + k, "b", rng.uniform(-5, 5), -180 + rng.uniform(0, 0.1)) for k in range(20)]
    out += [(600 + k, "c", 89.9 + rng.uniform(0, 0.1), rng.uniform(-180, 180)) for k in range(20)] + [(700, "d", 1.0, 2.0), (701, "a", None, 3.0), (702, None, 1.0, 1.0), (703, "a", math.nan, 1.0), (None, "a", 1.0, 1.0)]
    return out


@pytest.mark.parametrize("k,by", [(1, "g"), (3, "g"), (4, None)])
def test_k_nearest_against_all_pairs(spark, crowd, k, by):
    rng = random.Random(4)
    places = [(i, rng.choice("abcd"), math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for i in range(60)]
    places += [(100, "a", 55.0005, 12.0005), (101, "a", 10.0, 20.0), (102, "b", 0.0, 180.0), (103, "b", 0.0, -180.0), (104, "c", 90.0, 0.0), (105, "d", -89.0, 100.0), (106, "z", 1.0, 1.0), (107, "a", None, 1.0), (108, None, 1.0, 1.0), (None, "a", 1.0, 1.0), (100, "a", 55.0005, 12.0005)]
    schema = "k int, g string, lat double, lon double"
    df, st = spark.createDataFrame(places, schema), spark.createDataFrame(crowd, schema).withColumnRenamed("k", "s")
    got = {}
    for r in recipes.k_nearest(df, st, k, "k", "s", by).collect():
        got.setdefault(r["k"], {})[r["rank"]] = (r["s"], r["metres"])
    want = {}
    usable = [r for r in crowd if r[0] is not None and (r[1] is not None or not by) and r[2] is not None and not math.isnan(r[2])]
    for i, g, lat, lon in places:
        if i is None or lat is None or by and g is None:
            continue
        near = [r for r in usable if not by or r[1] == g]
        if near:
            s = geodesics.inverse(GRS80, *np.radians([np.full(len(near), lon), np.full(len(near), lat), [r[3] for r in near], [r[2] for r in near]]))[2]
            ranked = sorted(zip(np.nan_to_num(s, nan=2e7), (r[0] for r in near), strict=True))[:k]
            want[i] = {n: (station, metres) for n, (metres, station) in enumerate(ranked, 1)}
    assert set(got) == set(want)
    for i, ranks in want.items():
        assert {n: s for n, (s, _) in got[i].items()} == {n: s for n, (s, _) in ranks.items()}, i
        assert [got[i][n][1] for n in sorted(ranks)] == pytest.approx([ranks[n][1] for n in sorted(ranks)], abs=1e-5)


def test_neighbours_of_nothing(spark):
    schema = "k int, g string, lat double, lon double"
    none, one = spark.createDataFrame([], schema), spark.createDataFrame([(1, "a", 1.0, 1.0)], schema)
    st = lambda df: df.withColumnRenamed("k", "s")
    assert recipes.nearest(none, st(one), "k", "s", "g").collect() == [] and recipes.nearest(one, st(none), "k", "s", "g").collect() == []
    assert [tuple(r) for r in recipes.nearest(one, st(one), "k", "s").collect()] == [(1, 1, 0.0)]


# -- crossings --------------------------------------------------------------------------------


def test_crossings_against_all_pairs(spark):
    rng = random.Random(8)
    segments = [(k, *(rng.uniform(0, 10) for _ in range(2))) for k in range(150)]
    segments = [(k, x, y, x + rng.uniform(-1, 1), y + rng.uniform(-1, 1)) for k, x, y in segments]
    segments += [(200 + k, 5.0, 5.0, 5 + math.cos(k), 5 + math.sin(k)) for k in range(40)]  # all through one point
    segments += [(300, 0.0, 0.0, 10.0, 10.0), (301, 2.0, 2.0, 4.0, 4.0), (302, 3.0, 3.0, 12.0, 12.0), (303, 0.0, 3.0, 10.0, 3.0), (304, 3.0, -1.0, 3.0, 11.0), (305, 3.0, 3.0, 3.0, 3.0), (306, 400.0, 3.0, 10.0, 3.0)]
    odd = [(400, None, 1.0, 1.0, 1.0), (401, math.nan, 1.0, 1.0, 1.0), (402, math.inf, 1.0, 1.0, 1.0), (None, 0.0, 0.0, 10.0, 10.0)]
    schema = "id int, x1 double, y1 double, x2 double, y2 double"
    df = spark.createDataFrame(segments + odd, schema)
    both = df.alias("a").crossJoin(df.alias("b")).filter("a.id < b.id and a.x1 < 1e6 and b.x1 < 1e6")
    want = both.select("a.id", F.col("b.id").alias("id2"), F.explode(geo.intersection("a.x1", "a.y1", "a.x2", "a.y2", "b.x1", "b.y1", "b.x2", "b.y2")).alias("p")).select("id", "id2", "p.x", "p.y").collect()
    rounded = lambda rows: sorted((r[0], r[1], round(r[2], 6) + 0.0, round(r[3], 6) + 0.0) for r in rows)
    for full in (64, 4):
        assert rounded(crossings(df, full=full).collect()) == rounded(want)
    a, b = df.filter("id < 100"), df.filter("id >= 100")
    between = [r for r in want if r[0] < 100 <= r[1]]
    assert between and rounded(crossings(a, b).collect()) == rounded(between)
    assert crossings(df.filter("id > 1000")).collect() == []


def test_crossings_are_dealt_out_to_tasks(spark):
    """A small file is one task to read; the pairs that come of it are many tasks' work."""
    rng = random.Random(9)
    rows = [(f"k{k}", x, y, x + rng.uniform(-0.1, 0.1), y + rng.uniform(-0.1, 0.1)) for k, x, y in ((k, rng.random(), rng.random()) for k in range(1500))]
    df = spark.createDataFrame([*rows, ("k7", 0.0, 0.0, 1.0, 1.0)], "id string, x1 double, y1 double, x2 double, y2 double").coalesce(1)
    got = crossings(df)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    found = got.withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in found}) > 1
    pairs = [(r[0], r[1]) for r in found]
    assert all(a < b for a, b in pairs)
    # a key of two rows: they don't meet each other, and both meet the rest
    assert sorted((r[0], r[1], round(r[2], 9), round(r[3], 9)) for r in found) == sorted((r[0], r[1], round(r[2], 9), round(r[3], 9)) for r in crossings(df, full=4).collect())
    assert ("k7", "k7") not in pairs and len(pairs) > 1500


# -- geodesics, derivatives, counts -----------------------------------------------------------


def test_geodesics_as_expressions(spark):
    rng = np.random.default_rng(7)
    n = 3000
    lat1, lat2 = np.degrees(np.arcsin(rng.uniform(-1, 1, (2, n))))
    lon1, lon2 = rng.uniform(-180, 180, (2, n))
    lat2[:300], lon2[:300] = -lat1[:300] + rng.normal(size=300), lon1[:300] + 180 + rng.normal(size=300)  # near antipodes
    lat2[300:310], lon2[300:310] = lat1[300:310], lon1[300:310]
    lat1[310:314] = (90.0, -90.0, 90.0, 0.0)
    lat1[314], lon2[315] = math.nan, math.inf
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(lat1, lon1, lat2, lon2, strict=True)] + [(None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double").coalesce(1)
    got = geo.with_geodesic(df, "a", "b", "c", "d", "s", "az", "back").toPandas()
    with np.errstate(all="ignore"):
        az1, az2, s = geodesics.inverse(GRS80, *np.radians([lon1, lat1, lon2, lat2]))
    mine = got.iloc[:n]
    assert math.isnan(got["s"].iloc[n])
    both = np.isfinite(s) & mine["s"].notna().to_numpy()
    assert (np.isfinite(s) == mine["s"].notna()).mean() > 0.998 and both.sum() > 0.95 * n  # next to antipodes they may stop apart
    assert np.abs(s - mine["s"])[both].max() < 2e-3 and np.median(np.abs(s - mine["s"])[both]) < 1e-6
    easy = both & (s < 1.9e7)
    assert np.abs(s - mine["s"])[easy].max() < 1e-4
    assert np.abs(np.exp(1j * az1) - np.exp(1j * np.radians(mine["az"])))[easy & (s > 1)].max() < 1e-9
    plan = geo.with_geodesic(df, "a", "b", "c", "d")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    there = Pipeline("geodesic").transform(df.withColumns({"az": F.lit(33.0), "m": F.lit(5e6)}), "a", "b", "az", "m").toPandas().iloc[:n]
    lon, lat, _ = geodesics.direct(GRS80, np.radians(lon1), np.radians(lat1), np.radians(33.0), 5e6)
    assert np.allclose(there["x"], np.degrees(lat), atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("text", [
    "utm zone=32", "merc", "webmerc", "lcc lat_1=50 lat_2=60 lon_0=10", "laea lat_0=52 lon_0=10", "stere lat_0=52 lon_0=10", "aea lat_1=40 lat_2=60", "omerc latc=55 lonc=12 alpha=30", "robin", "moll", "krovak", "eqearth", "geos h=35785831",
    "bonne lat_1=50", "cea", "qsc lat_0=90", "somerc lat_0=50 lon_0=10", "nzmg", "alsk", "sterea lat_0=52 lon_0=5", "poly",
])
def test_derivatives_are_those_of_differences(text):
    p = Pipeline(text)
    lon, lat = np.radians([8.5, 11.0, 15.5]), np.radians([54.3, 56.0, 57.7])
    if text == "nzmg":
        lon, lat = np.radians([172.0, 174.5]), np.radians([-40.0, -43.0])
    if text == "alsk":
        lon, lat = np.radians([-150.0, -140.0]), np.radians([60.0, 64.0])
    if p.on_arrays:
        pytest.skip("iterates")
    (x, y, *_), _ = p.run(Dual(Np), D(lon, 1.0, 0.0), D(lat, 0.0, 1.0), 0.0, math.nan)
    h = 1e-5
    for k, (dx, dy) in enumerate(((h, 0), (0, h))):
        a, b, c, d = (p.arrays(lon + i * dx, lat + i * dy) for i in (-2, -1, 1, 2))
        for got, n in ((x, "x"), (y, "y")):
            want = ((a[n] - d[n]) + 8 * (c[n] - b[n])) / (12 * h)
            assert np.allclose((got.x, got.y)[k], want, rtol=1e-6, atol=2.0), n


def test_factors_of_conformal_and_equal_area_maps(spark):
    df = spark.createDataFrame([(float(a), float(b)) for a in (0.12, 0.2, 0.29) for b in (0.94, 1.0, 1.08)] + [(None, 1.0)], "lon double, lat double")
    for text in ("utm zone=32", "lcc lat_1=50 lat_2=60 lon_0=10", "stere lat_0=52 lon_0=10", "merc"):
        got = factors(df, Pipeline(text), "lon", "lat").toPandas()
        assert got["angular_distortion"].max() < 1e-12 if text in ("merc", "stere lat_0=52 lon_0=10") else got["angular_distortion"].max() < 1e-10, text
        assert np.allclose(got["meridional_scale"], got["parallel_scale"], rtol=1e-9, equal_nan=True) and got.iloc[-1][list(NAMES)].isna().all()
    got = factors(df, Pipeline("laea lat_0=52 lon_0=10"), "lon", "lat").toPandas()
    assert np.allclose(got["areal_scale"][:9], 1, atol=1e-9) and np.allclose(got["tissot_semimajor"][:9] * got["tissot_semiminor"][:9], 1, atol=1e-9)
    far = factors(df.limit(9), Pipeline("aeqd lat_0=52 lon_0=10"), "lon", "lat").toPandas()  # by differences
    assert (far["tissot_semimajor"] >= far["tissot_semiminor"]).all() and far["areal_scale"].between(0.99, 1.02).all()


@pytest.mark.parametrize("text", ["gis:in | utm zone=32 | noop", "gis:in | cass lon_0=10 | addone"])
def test_counts_are_taken_on_the_pass(spark, tmp_path, text):
    rng = random.Random(1)
    rows = [(rng.uniform(-200, 200), rng.uniform(-95, 95)) for _ in range(500)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    df.write.parquet(str(tmp_path / "in"))
    p, seen = Pipeline(text), Observation("pass")
    out = p.transform(spark.read.parquet(str(tmp_path / "in")), "lon", "lat", observe=seen)
    assert out.columns == p.transform(df, "lon", "lat").columns
    out.write.parquet(str(tmp_path / "out"))
    want = p.success_counts(df, "lon", "lat").first().asDict()
    assert seen.get == want and 0 < want["successes"] < want["n"]
    stream = p.transform(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "lon", "lat", observe="pass")
    query = stream.writeStream.format("noop").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [x.observedMetrics["pass"].asDict() for x in query.recentProgress if x.observedMetrics and x.observedMetrics["pass"]["n"]] == [want]
