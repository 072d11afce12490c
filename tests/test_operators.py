"""Operators against published positions, there and back, and columns against arrays."""

import math

import numpy as np
import pytest
from golden import GOLDEN

from geoquill.functions import angles, geodesics
from geoquill.functions.ellipsoid import NAMED, Ellipsoid
from geoquill.functions.mathx import Np
from geoquill.plans.language import PipelineError
from geoquill.plans.pipeline import Context, Pipeline
from geoquill.plans.proj import native
from geoquill.plans.registry import OPERATORS

RAD = math.pi / 180


@pytest.mark.parametrize("definition,lat,lon,x,y,tolerance", GOLDEN, ids=[f"{k}-{g[0].split()[0]}" for k, g in enumerate(GOLDEN)])
def test_golden(definition, lat, lon, x, y, tolerance):
    p = Pipeline(definition)
    out = p.arrays(lon * RAD, lat * RAD)
    assert math.hypot(out.x[0] - x, out.y[0] - y) <= tolerance
    back = p.arrays(out.x, out.y, 0.0, 0.0, "inv")
    assert math.hypot(back.x[0] - lon * RAD, back.y[0] - lat * RAD) < 1e-9


#: definition, then middle of an area (latitude, longitude), and how well there and back agrees (radians or metres).
THERE_AND_BACK = [
    ("alsk", 64, -152, 1e-9), ("gs48", 39, -96, 1e-9), ("gs50", 45, -120, 1e-9), ("nzmg", -41, 173, 1e-4), ("calcofi", 30, -120, 1e-9), ("qsc", 5, 5, 1e-9), ("qsc lon_0=90", 5, 90, 1e-9),
    ("qsc lon_0=180", 5, 178, 1e-9), ("qsc lon_0=-90", 5, -90, 1e-9), ("qsc lat_0=90", 80, 20, 1e-9), ("qsc lat_0=-90", -80, 20, 1e-9), ("som inc_angle=98 ps_rev=0.0687 asc_lon=40", 54, 10, 1e-5),
    ("misrsom path=100", 54, 10, 1e-5), ("lsat lsat=5 path=100", 54, 10, 1e-5), ("rouss lat_0=55 lon_0=10", 54, 10, 1e-5), ("tmgrid lon_i=-180 zone_width=6 x_0=500000", 54, 10, 1e-9),
    ("geos h=35785831 lon_0=10", 40, 10, 1e-9), ("geos h=35785831 sweep=x", 40, 10, 1e-9), ("leac lat_1=50", 54, 10, 1e-9), ("mod_krovak", 50, 15, 1e-9), ("poly lon_0=10", 54, 10, 1e-9),
    ("molodensky dx=84 dy=107 dz=120 da=-251 df=-0.000014", 54, 10, 1e-7), ("permtide from=mean to=free", 54, 10, 1e-12), ("geogoffset dlon=3 dlat=1", 54, 10, 1e-12), ("latitude authalic", 54, 10, 1e-12),
    ("latitude conformal", 54, 10, 1e-12), ("latitude rectifying", 54, 10, 1e-12), ("latitude reduced", 54, 10, 1e-12), ("cart", 54, 10, 1e-12), ("ocea lat_0=50 alpha=30 lonc=10", 54, 10, 1e-9), ("moll", 54, 10, 1e-9),
    ("robin", 54, 10, 1e-9), ("bonne lat_1=-50", -54, 10, 1e-9), ("tpeqd lat_1=50 lon_1=8 lat_2=58 lon_2=14", 54, 10, 1e-9), ("cass lat_0=50 lon_0=10", 54, 10, 1e-9), ("ortho lat_0=52 lon_0=10", 54, 10, 1e-9),
]


@pytest.mark.parametrize("definition,lat,lon,tolerance", THERE_AND_BACK, ids=[t[0] for t in THERE_AND_BACK])
def test_there_and_back(definition, lat, lon, tolerance):
    rng = np.random.default_rng(3)
    y, x = (lat + rng.uniform(-2, 2, 200)) * RAD, (lon + rng.uniform(-2, 2, 200)) * RAD
    p = Pipeline(definition)
    out = p.arrays(x, y, 50.0, 2010.0)
    back = p.arrays(out.x, out.y, out.z, out.t, "inv")
    assert out.ok.all() and back.ok.all()
    assert np.abs(back.x - x).max() < tolerance and np.abs(back.y - y).max() < tolerance


def test_all_operators_are_here():
    Pipeline("noop")
    assert len(NAMED) == 47
    survey = "addone curvature deflection dm dms geodesic gravity noop aea aeqd cea etmerc laea lcc leac merc omerc stere sterea tmerc utm ups webmerc alsk gs48 gs50 bonne calcofi cass col_urban eqc eqdc eqearth geos guam_aeqd gstmerc krovak mod_krovak labrd lccnc lcca mill moll nzmg ocea ortho poly qsc robin rouss sinu som misrsom lsat somerc tcea tmgrid tpeqd tunmg adapt axisswap lonlat cart deformation gridshift helmert latitude molobadekas molodensky permtide unitconvert geogoffset btmerc butm"
    assert set(survey.split()) <= set(OPERATORS)


@pytest.mark.parametrize("definition", ["utm zone=32", "utm zone=32 inv", "lcc lat_1=33 lat_2=45", "stere lat_0=52", "krovak", "robin", "moll inv", "cart | helmert x=1 rx=1 s=2 convention=position_vector | cart inv", "omerc latc=55 lonc=12 alpha=30", "qsc lat_0=90", "eqearth inv"])
def test_columns_equal_arrays(spark, definition):
    rng = np.random.default_rng(4)
    scale = 1e5 if definition.endswith("inv") and "cart" not in definition else 1.0
    y, x = rng.uniform(50, 58, 30) * RAD * scale, rng.uniform(6, 14, 30) * RAD * scale
    y[0] = np.nan
    df = spark.createDataFrame([(i, float(a), None if i == 1 else float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "i int, lon double, lat double").coalesce(1)
    y[1] = np.nan
    p = Pipeline(definition)
    expected = p.arrays(x, y)
    for engine in ("columns", "arrow"):
        got = p.transform(df, "lon", "lat", engine=engine).orderBy("i").toPandas()
        assert list(got.ok) == list(expected.ok) and not got.ok[0] and not got.ok[1] and got.ok[2:].all()
        assert np.allclose(got[["x", "y"]], expected[["x", "y"]], rtol=1e-9, atol=1e-7, equal_nan=True)


# -- transformations --------------------------------------------------------------------------


def near(out, *expected, within):
    assert math.dist([out[k][0] for k in "xyz"[: len(expected)]], expected) < within


def test_helmert():
    near(Pipeline("helmert x=-87 y=-96 z=-120").arrays(0.0, 0.0), -87, -96, -120, within=1e-12)
    near(Pipeline("helmert translation=-87,-96,-120").arrays(0.0, 0.0), -87, -96, -120, within=1e-12)
    gda = "helmert exact convention=coordinate_frame x=0.06155 rx=-0.0394924 y=-0.01087 ry=-0.0327221 z=-0.04019 rz=-0.0328979 s=-0.009994"
    near(Pipeline(gda).arrays(-4052051.7643, 4212836.2017, -2545106.0245), -4052052.7379, 4212835.9897, -2545104.5898, within=7.5e-5)
    rates = "helmert exact convention=coordinate_frame drx=0.00150379 dry=0.00118346 drz=0.00120716 t_epoch=2020.0"
    near(Pipeline(rates).arrays(-4052052.6588, 4212835.9938, -2545104.6946, 2018.0), -4052052.7373, 4212835.9835, -2545104.5867, within=4e-5)
    fixed = Pipeline(rates + " t_obs=2018")
    near(fixed.arrays(-4052052.6588, 4212835.9938, -2545104.6946, 1990.0), -4052052.7373, 4212835.9835, -2545104.5867, within=4e-5)
    near(Pipeline("helmert x=-9597.3572 y=.6112 s=0.304794780637 theta=-1.244048").arrays(2546506.957, 542256.609), 766563.675, 165282.277, within=1e-3)
    for bad in ("helmert transpose", "helmert rx=1", "helmert dx=1", "helmert towgs84=1,2,3", "molobadekas", "helmert rx=1 convention=other"):
        with pytest.raises(PipelineError):
            Pipeline(bad)


def test_small_operators():
    near(Pipeline("cart").arrays(0.0, 85 * RAD, 100000.0), 566462.6335374768, 0, 6432020.333690127, within=1e-6)
    assert Pipeline("latitude geocentric").arrays(0.0, 55 * RAD).y[0] / RAD == pytest.approx(54.8189733083245, abs=1e-12)
    out = Pipeline("dm").arrays(5530.15, -1245.15)
    assert (out.x[0] / RAD, out.y[0] / RAD) == (pytest.approx(-12.7525, abs=1e-12), pytest.approx(55.5025, abs=1e-12))
    out = Pipeline("dms").arrays(553036.0, -124509.0)
    assert (out.x[0] / RAD, out.y[0] / RAD) == (pytest.approx(-12.7525, abs=1e-12), pytest.approx(55.51, abs=1e-12))
    near(Pipeline("unitconvert xy_in=us-ft z_in=us-ft").arrays(5.0, 5.0, 5.0), 1.524003048, 1.524003048, 1.524003048, within=1e-8)
    for bad in ("unitconvert xy_in=deg xy_out=m", "unitconvert xy_in=parsec", "adapt from=neue", "axisswap order=1,1", "utm zone=61", "nosuch", "curvature", "gravity grs80 welmec", "latitude", "permtide from=mean to=x", "bonne lat_1=0", "lcc lat_1=30 lat_2=-30", "curvature mean inv"):
        with pytest.raises(PipelineError):
            Pipeline(bad)
    near(Pipeline("adapt from=nwuf_deg to=seuf").arrays(55.0, 12.0, 3.0), -55 * RAD, -12 * RAD, 3.0, within=1e-12)
    back = Pipeline("adapt from=nwuf_deg").arrays(55.0, 12.0, 3.0)
    near(back, -12 * RAD, 55 * RAD, 3.0, within=1e-12)
    near(Pipeline("adapt from=nwuf_deg").arrays(back.x, back.y, back.z, 0.0, "inv"), 55, 12, 3, within=1e-12)
    assert Pipeline("gravity grs67").arrays(45.0, 0.0).x[0] == pytest.approx(9.8062, abs=1e-3)


def test_geodesics():
    e = Ellipsoid.named("WGS84")
    az1, az2, s = geodesics.inverse(e, -139.44815 * RAD, 35.60777 * RAD, -69.95921 * RAD, -11.17491 * RAD)
    assert (az1 / RAD, az2 / RAD) == (pytest.approx(111.09874842956033, abs=1e-8), pytest.approx(129.28927088970877, abs=1e-8)) and s == pytest.approx(8935244.56048183, abs=1e-3)
    lon, lat, _ = geodesics.direct(e, -139.44815 * RAD, 35.60777 * RAD, az1, s)
    assert (lon / RAD, lat / RAD) == (pytest.approx(-69.95921, abs=1e-9), pytest.approx(-11.17491, abs=1e-9))
    assert geodesics.inverse(Ellipsoid.named("GRS80"), 12 * RAD, 55 * RAD, 2 * RAD, 49 * RAD)[2] == pytest.approx(956066.231959, abs=1e-5)
    assert [float(v) for v in geodesics.inverse(e, 0.1, 0.2, 0.1, 0.2)] == [0, 0, 0]
    assert np.isnan(geodesics.inverse(e, 0.0, 0.0, math.pi, 1e-9)[2])
    out = Pipeline("geodesic inv").arrays(55.0, 12.0, 49.0, 2.0)
    assert out.z[0] == pytest.approx(956066.231959, abs=1e-5)


def test_series_equal_the_functions():
    for name in ("GRS80", "bessel", "mprts"):
        e = Ellipsoid.named(name)
        phi = np.linspace(-1.5, 1.5, 61)
        for series, g in ((e.rectifying, e._mu), (e.conformal, e._chi), (e.authalic, e._xi)):
            assert np.abs(e.along(Np, series[0], phi) - g(phi)).max() < 2e-13 if name != "mprts" else 1e-11
            assert np.abs(e.along(Np, series[1], g(phi)) - phi).max() < 1e-11
        assert np.abs(e.from_isometric(Np, e.isometric(Np, phi)) - phi).max() < 1e-13
    with pytest.raises(ValueError):
        Ellipsoid.named("nowhere")
    assert Ellipsoid.named("(6378137, 0)").spherical


def test_angles():
    assert angles.parse("12:30") == 12.5 and angles.parse("12:30:36N") == pytest.approx(12.51) and angles.parse("-0:30") == -0.5 and angles.parse("10:30W") == -10.5
    assert math.isnan(angles.parse("ten"))


# -- the language -----------------------------------------------------------------------------


def test_pipelines_and_macros():
    c = Context()
    c.register_macro("sub:three", "addone inv | addone inv|addone inv")
    c.register_macro("add:n", "addone | sub:three | geogoffset dlon=$far(3600) dlat=(0)")
    assert c.pipeline("addone|addone inv|addone").arrays(55.0, 0.0).x[0] == 56
    assert c.pipeline("addone|sub:three inv").arrays(55.0, 0.0).x[0] == 59
    assert c.pipeline("addone|sub:three inv").arrays(59.0, 0.0, direction="inv").x[0] == 55
    assert c.pipeline("add:n").arrays(0.0, 0.0).x[0] == pytest.approx(-2 + RAD)
    assert c.pipeline("add:n far=7200").arrays(0.0, 0.0).x[0] == pytest.approx(-2 + 2 * RAD)
    assert c.pipeline("add:n dlat=3600").arrays(0.0, 0.0).y[0] == pytest.approx(RAD)
    assert c.pipeline("addone > addone < addone # comment\n").arrays(0.0, 0.0).x[0] == 2
    assert c.pipeline("addone > addone < addone").arrays(0.0, 0.0, direction="inv").x[0] == -2
    assert c.pipeline("inv addone").arrays(0.0, 0.0).x[0] == -1
    assert c.pipeline("utm zone = 32 : ").describe() == [{"name": "utm", "zone": "32"}]
    c.register_macro("a:b", "c:d")
    c.register_macro("c:d", "a:b")
    for bad in ("a:b", "no:macro", "addone | pipeline", "geogoffset dlon=$nothing"):
        with pytest.raises(PipelineError):
            c.pipeline(bad)


def test_readme_example():
    out = Pipeline("geo:in | utm zone=33").arrays([55.0, 59.0], [12.0, 18.0])
    assert np.allclose(out[["x", "y"]], [[308124.36786, 6098907.82501], [672319.96409, 6543920.33413]], atol=1e-5)


def test_stack():
    run = lambda text, *v: [float(x) for x in Pipeline(text).arrays(*v)[list("xyz")].iloc[0]]
    assert run("stack push=1,2 | stack pop=1,2", 1.0, 2.0, 3.0) == [2, 1, 3]
    assert run("stack push=1,2,3 | addone | stack roll=3,2 | stack pop=3,2,1", 1.0, 2.0, 3.0) == [2, 3, 1]
    assert run("stack push=1,2,3 | stack roll=3,2 | stack unroll=3,2 | stack pop=3,2,1", 1.0, 2.0, 3.0) == [1, 2, 3]
    assert run("stack push=1 | addone | stack flip=1 | stack pop=2", 5.0, 2.0, 3.0) == [5, 6, 3]
    assert run("push v_3 v_2 | addone | pop v_3 v_2", 5.0, 2.0, 3.0) == [6, 2, 3]
    assert run("stack push=1,2 | stack drop | stack pop=3", 1.0, 2.0, 3.0) == [1, 2, 1]
    assert all(map(math.isnan, run("stack push=1 | stack pop=1,2", 1.0, 2.0, 3.0)))
    with pytest.raises(PipelineError):
        Pipeline("stack push=5")
    p = Pipeline("stack push=1,2 | stack pop=1,2")
    assert float(p.arrays(2.0, 1.0, direction="inv").x[0]) == 1.0


def test_user_operator():
    from geoquill.plans.registry import Op

    c = Context()
    c.register_operator("double", lambda p: Op(lambda m, x, y, z, t: (x * p.real("by", 2.0), y, z, t)))
    assert c.pipeline("double | addone").arrays(4.0, 0.0).x[0] == 9 and c.pipeline("double by=3").arrays(4.0, 0.0).x[0] == 12


def test_proj_strings():
    assert native("+proj=pipeline +ellps=intl +step +inv +proj=utm +zone=32 +step +proj=utm +zone=33") == "utm inv ellps=intl zone=32 | utm ellps=intl zone=33"
    assert native("+proj=pipeline +inv +step +proj=utm +zone=32 +step +proj=cart") == "cart inv | utm inv zone=32"
    assert native("proj=merc k=0.99 pm=paris").startswith("merc k_0=0.99 lon_0=2.337229")
    assert native("proj=merc R=6400000 axis=wsu") == "merc ellps=6400000,0 | axisswap order=-1,-2,3"
    assert native("utm zone=32") == "utm zone=32"
    for bad in ("proj=utm init=epsg:1 zone=1", "proj=utm zone=3 step proj=pipeline step proj=merc", "proj=merc pm=atlantis"):
        with pytest.raises(PipelineError):
            native(bad)
