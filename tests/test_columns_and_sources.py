"""Column functions, recipes, registers, GeoTIFF grids, operators on points, windows, and what filters reach."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoquill.functions import columns as geo
from geoquill.functions import geodesics
from geoquill.functions.ellipsoid import Ellipsoid, Np
from geoquill.plans import recipes, registers
from geoquill.plans.language import PipelineError
from geoquill.plans.pipeline import Context, Pipeline
from geoquill.sources import geotiff, gridfiles, gridstore
from geoquill.streaming import centroids, sessions, sliding

GRS80 = Ellipsoid.named("GRS80")


# -- columns ----------------------------------------------------------------------------------


def test_columns_agree_with_arrays(spark):
    lat, lon, h = np.array([-80.0, -12.5, 0.0, 33.3, 55.0, 88.0]), np.array([-170.0, -3.0, 0.0, 12.0, 99.0, 179.0]), np.array([0.0, 100.0, -50.0, 2000.0, 30.0, 8000.0])
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(lat, lon, h, strict=True)], "lat double, lon double, h double").coalesce(1)
    phi, lam = np.radians(lat), np.radians(lon)
    xyz = GRS80.cartesian(Np, lam, phi, h)
    expected = {
        "prime": (geo.prime_vertical("lat"), GRS80.prime_vertical(Np, phi)), "meridian": (geo.meridian("lat"), GRS80.meridian(Np, phi)),
        "arc": (geo.meridian_distance("lat"), GRS80.arc(Np, phi)), "iso": (geo.isometric("lat"), GRS80.isometric(Np, phi)),
        "back": (geo.latitude_of_distance(geo.meridian_distance("lat")), lat), "iso_back": (geo.from_isometric(geo.isometric("lat")), lat),
        "east": (geo.azimuthal_radius("lat", F.lit(90.0)), GRS80.prime_vertical(Np, phi)), "x": (geo.cartesian("lon", "lat", "h")["x"], xyz[0]), "z": (geo.cartesian("lon", "lat", "h")["z"], xyz[2]),
        "there": (geo.geographic(*(geo.cartesian("lon", "lat", "h")[c] for c in "xyz"))["lat"], lat), "dms": (geo.from_dms(geo.dms("lat")), lat), "g": (geo.somigliana("lat"), 9.78 + 0 * lat),
    }
    for kind in geo.LATITUDES:
        expected[kind] = (geo.latitude(geo.latitude("lat", kind), kind, inverse=True), lat)
    got = df.select(*[c.alias(n) for n, (c, _) in expected.items()]).toPandas()
    for n, (_, v) in expected.items():
        assert np.allclose(got[n], v, rtol=6e-3 if n == "g" else 1e-9, atol=1e-7), n
    with pytest.raises(ValueError):
        geo.latitude("lat", "other")


def test_geodesic_columns(spark):
    rows = [(55.0, 12.0, 49.0, 2.0), (0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.2, 179.9), (None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").coalesce(1)
    got = df.select(geo.distance("a", "b", "c", "d").alias("s"), geo.azimuth("a", "b", "c", "d").alias("z"), geo.destination("a", "b", geo.azimuth("a", "b", "c", "d"), geo.distance("a", "b", "c", "d")).alias("e")).collect()
    assert got[0]["s"] == pytest.approx(956066.231959, abs=1e-5)
    assert (got[0]["e"]["lat"], got[0]["e"]["lon"]) == pytest.approx((49.0, 2.0), abs=1e-9)
    assert got[1]["s"] == 0 and got[3]["s"] is None
    assert geo.distance("a", "b", "c", "d") is not None


def test_geodesics_of_many_rows_hold_the_hard_ones_apart():
    rng = np.random.default_rng(5)
    lat1, lon1, lat2, lon2 = (rng.uniform(-1.5, 1.5, 500) for _ in range(4))
    lat2[7], lon2[7] = -lat1[7] + 1e-5, lon1[7] + math.pi - 1e-5  # nearly antipodes
    az, back, s = geodesics.inverse(GRS80, lon1, lat1, lon2, lat2)
    for k in (0, 3, 7, 499):
        one = geodesics.inverse(GRS80, lon1[k], lat1[k], lon2[k], lat2[k])
        assert np.array_equal([az[k], back[k], s[k]], [float(v) for v in one], equal_nan=True)
    good = np.isfinite(s)
    lon, lat, _ = geodesics.direct(GRS80, lon1[good], lat1[good], az[good], s[good])
    assert good.sum() >= 498 and np.allclose(lat, lat2[good], atol=1e-10) and np.allclose(np.exp(1j * lon), np.exp(1j * lon2[good]), atol=1e-9)


def test_segments(spark):
    cases = [
        ((0, 0, 4, 4, 0, 4, 4, 0), [(2, 2)]), ((0, 0, 1, 1, 2, 2, 3, 3), []), ((0, 0, 2, 2, 1, 1, 3, 3), [(1, 1), (2, 2)]), ((0, 0, 1, 0, 1, 0, 2, 5), [(1, 0)]), ((0, 0, 1, 0, 0, 1, 1, 1), []),
        ((0, 0, 3, 0, 1, 0, 2, 0), [(1, 0), (2, 0)]), ((1, 1, 1, 1, 0, 0, 2, 2), [(1, 1)]), ((1, 1, 1, 1, 1, 1, 1, 1), [(1, 1)]), ((1, 1, 1, 1, 2, 2, 2, 2), []), ((0, 0, 1, 1, 3, 0, 3, 9), []),
    ]
    df = spark.createDataFrame([(k, *map(float, c)) for k, (c, _) in enumerate(cases)], "k int, a double, b double, c double, d double, e double, f double, g double, h double")
    got = {r["k"]: sorted((p["x"], p["y"]) for p in r["p"]) for r in df.select("k", geo.intersection(*"abcdefgh").alias("p")).collect()}
    assert got == {k: [tuple(map(float, p)) for p in points] for k, (_, points) in enumerate(cases)}


# -- recipes ----------------------------------------------------------------------------------


def test_nearest_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    places = [(k, f"g{k % 3}", float(rng.uniform(-85, 85)), float(rng.uniform(-180, 180))) for k in range(250)] + [(999, "none", 1.0, 1.0)]
    # one group of very many stations close together and a few far away, one of two stations, one spread out
    stations = [(k, "g0", float(50 + rng.normal(0, 0.5)), float(10 + rng.normal(0, 0.5))) for k in range(300)] + [(300 + k, "g0", -60.0, 170.0 + 3 * k) for k in range(5)]
    stations += [(400, "g1", 10.0, 179.0), (401, "g1", 10.0, -179.0)] + [(500 + k, "g2", float(rng.uniform(-85, 85)), float(rng.uniform(-180, 180))) for k in range(400)]
    a = spark.createDataFrame(places, "k long, g string, lat double, lon double")
    b = spark.createDataFrame(stations, "s long, g string, lat double, lon double")
    got = {r["k"]: (r["s"], r["metres"]) for r in recipes.nearest(a, b, "k", "s", "g").collect()}
    assert len(got) == 250
    for k, g, lat, lon in places[:250]:
        mine = [x for x in stations if x[1] == g]
        s = geodesics.inverse(GRS80, *np.radians([np.full(len(mine), lon), np.full(len(mine), lat)]), *np.radians(np.array([(x[3], x[2]) for x in mine]).T))[2]
        s = np.where(np.isnan(s), 2e7, s)
        assert got[k][1] == pytest.approx(s.min(), abs=1e-6) and got[k][0] == mine[int(s.argmin())][0]


def test_route_length(spark):
    stops = spark.createDataFrame([("a", 1, 55.0, 12.0), ("a", 2, 49.0, 2.0), ("a", 3, 55.0, 12.0), ("b", 1, 1.0, 1.0)], "c string, n int, lat double, lon double")
    got = {r["c"]: (r["metres"], r["n"]) for r in recipes.route_length(stops, "c", ["n"]).collect()}
    assert got["a"] == (pytest.approx(2 * 956066.231959, abs=1e-4), 3) and got["b"] == (0.0, 1)


# -- plans ------------------------------------------------------------------------------------


def test_filters_on_input_columns_reach_the_scan(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "id % 5 AS part", "CAST(id AS DOUBLE) / 100 AS lon", "CAST(id AS DOUBLE) / 90 AS lat")
    df.write.partitionBy("part").parquet(str(tmp_path / "t"))
    out = Pipeline("cart | helmert x=1 y=2 z=3 | cart inv | utm zone=32").transform(spark.read.parquet(str(tmp_path / "t")), "lon", "lat")
    filtered = out.filter("part = 3 AND id > 50 AND ok AND x < 1e9")
    plan = filtered._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan") :]
    assert "PartitionFilters: [isnotnull(part" in scan and "GreaterThan(id,50)" in scan
    assert plan.count("atan2") < 8 and filtered.count() > 0  # the expressions aren't written out again for the filter
    assert sorted(r["id"] for r in filtered.collect()) == sorted(r["id"] for r in out.collect() if r["part"] == 3 and r["id"] > 50 and r["ok"] and r["x"] < 1e9)


def test_generated_methods_stay_small(spark, tmp_path):
    spark.range(10).selectExpr("id / 100 AS lon", "id / 90 AS lat", "2000.0D + id AS t").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    rates = "helmert convention=coordinate_frame exact x=0.06155 rx=-0.0394924 y=-0.01087 ry=-0.0327221 z=-0.04019 rz=-0.0328979 s=-0.009994"
    for text in (f"cart | {rates} | {rates} inv | helmert x=1 y=2 z=3 | cart inv | utm zone=33", " | ".join(["utm zone=33", "utm zone=33 inv"] * 3)):
        out = Pipeline(text).transform(df, "lon", "lat", t="t").agg(F.sum("x"), F.sum("y"))
        out.collect()
        found = out._jdf.queryExecution().debug().codegenToSeq()
        assert max(found.apply(k)._3().maxMethodCodeSize() for k in range(found.size())) < 8000


# -- registers and operators of one's own -------------------------------------------------------


def test_macros_in_files(tmp_path):
    folder = tmp_path / "resources"
    folder.mkdir()
    (folder / "my_alone.resource").write_text("addone | addone\n")
    (folder / "my.md").write_text("# Text\n\n```any:two\naddone |\naddone\n```\n\n```any:up\nmy:two | addone by=$n(1)\n```\n```any:open\naddone")
    c = Context([str(tmp_path)])
    value = lambda text: float(c.pipeline(text).arrays(np.array([1.0]), np.array([2.0]))["x"].iloc[0])
    assert value("my:two") == 3 and value("my:alone") == 3 and value("my:up inv") == -2 and value("my:open") == 2
    for missing in ("my:none", "other:two", "../my:two"):
        with pytest.raises(PipelineError):
            c.pipeline(missing)
    assert registers.blocks("```x:a\n1\n```\n```x:a\n2\n```") == {"a": "1"}
    c.register_text("own", "```x:three\naddone | addone | addone\n```")
    assert value("own:three") == 4
    x = Pipeline("TM:DKTM1").arrays(55.0, 9.0)
    assert float(x["x"].iloc[0]) == pytest.approx(200000.0)


def test_bundled_similarities():
    at = lambda text, *c: Pipeline(text).arrays(*c).iloc[0, :3].to_numpy(float)
    # fixed values: a published position
    for text in ("X:geo_gr96_qoornoq inv", "X:geo_qoornoq_gr96"):
        assert np.allclose(at(text, 64.0, -51.0, 0.0), (63.9987190817, -50.9955435843, 30.8619079967), rtol=0, atol=(1e-10, 1e-10, 1e-8))
    for name in ("qoornoq", "ammassalik", "scoresbysund"):
        assert np.allclose(at(f"X:geo_gr96_{name} | X:geo_gr96_{name} inv", 64.0, -51.0, 5.0), (64, -51, 5), rtol=0, atol=1e-8)
        assert np.allclose(at(f"X:geo_gr96_{name}", 64.0, -51.0, 5.0), at(f"geo:in | cart | X:gr96_{name} | cart inv ellps=intl | geo:out", 64.0, -51.0, 5.0), atol=1e-9)
    for whole in ("X:geo_gr96_ammassalik_xyz | cart inv ellps=intl | geo:out", "geo:in | cart | X:xyz_gr96_ammassalik_geo"):
        assert np.allclose(at(whole, 64.0, -51.0, 5.0), at("X:geo_gr96_ammassalik", 64.0, -51.0, 5.0), atol=1e-9)
    # the plate turns by the rates, and stands at their epoch
    still = "helmert exact convention=position_vector translation=-0.30031,-1.17512,-0.30654 rotation=0.041614,-0.026303,-0.011214 scale=-0.01626"
    here = at("cart", -0.8, 1.1, 5.0)
    assert np.allclose(at("X:itrf2020_gr96", *here, 2021.6164), at(still, *here, 2021.6164), atol=1e-9)
    moved = np.linalg.norm(at("X:itrf2020_gr96", *here, 2031.6164) - at("X:itrf2020_gr96", *here, 2021.6164))
    assert 0.1 < moved < 0.3


@pytest.mark.parametrize("name,move,turn,scale,years", [
    ("nkg:itrf2014-sweref99", (0.03054, 0.04606, -0.07944), (1419.58, 151.32, 1503.37), 0.003002, -0.5),
    ("nkg:itrf2014-etrs89dk", (0.66818, 0.04453, -0.45049), (3128.83, -23734.23, 4429.69), -0.003136, 15.829),
])
def test_bundled_national_frames(spark, name, move, turn, scale, years):
    """Against the steps reckoned one by one: everywhere the same velocity, so the deformation is a plain shift."""
    speed = np.array([3.0, -2.0, 8.0])  # millimetres a year east, north, up
    c = Context()
    for g in ("nkgrf17vel", "own"):
        c.register_grid(g, gridfiles.Grid(g, np.radians(75), np.radians(0), np.radians(5), np.radians(10), np.broadcast_to(speed, (9, 5, 3)).copy(), "velocity"))
    lat, lon, h, t = np.array([55.0, 60.0, 67.5]), np.array([12.0, 17.0, 20.0]), np.array([30.0, 0.0, 400.0]), np.array([2025.0, 2010.5, 1999.0])
    out = c.pipeline(name).arrays(lat, lon, h, t)
    assert out.equals(c.pipeline(f"{name} grids=own").arrays(lat, lon, h, t)) and out["ok"].all() and np.array_equal(out["t"], t)
    e = Pipeline("geo:in | cart").arrays(lat, lon, h, t)[["x", "y", "z"]].to_numpy()
    up = np.stack((np.cos(np.radians(lat)) * np.cos(np.radians(lon)), np.cos(np.radians(lat)) * np.sin(np.radians(lon)), np.sin(np.radians(lat))), axis=1)
    east = np.stack((-np.sin(np.radians(lon)), np.cos(np.radians(lon)), 0 * lon), axis=1)
    drift = 1e-3 * (speed[0] * east + speed[1] * np.cross(up, east) + speed[2] * up)
    arc = np.radians(1e-6 / 3600)
    x = e + np.cross(np.array([85, 531, -770]) * arc * (t - 1989)[:, None], e) - drift * (t - 2000)[:, None]
    x = (1 + scale * 1e-6) * (x + np.cross(np.array(turn) * arc, x)) + move + drift * years
    got = Pipeline("geo:in | cart").arrays(out["x"].to_numpy(), out["y"].to_numpy(), out["z"].to_numpy(), t)[["x", "y", "z"]].to_numpy()
    assert np.abs(got - x).max() < 1e-6
    back = c.pipeline(f"{name} inv").arrays(out["x"].to_numpy(), out["y"].to_numpy(), out["z"].to_numpy(), t)
    assert np.abs(back["x"] - lat).max() < 1e-9 and np.abs(back["y"] - lon).max() < 1e-9 and np.abs(back["z"] - h).max() < 1e-5


def test_operators_on_points(spark):
    class Twice:
        def __init__(self, by):
            self.by = by

        def fwd(self, c):
            return None if c[0] < 0 else (c[0] * self.by, *c[1:])

        def inv(self, c):
            return (c[0] / self.by, *c[1:])

    class OneWay:
        def fwd(self, c):
            return c

    c = Context()
    c.register_point_operator("twice", lambda p: Twice(p.real("by", 2.0)))
    c.register_point_operator("oneway", lambda p: OneWay())
    df = spark.createDataFrame([(1.0, 5.0), (-1.0, 6.0)], "a double, b double").coalesce(1)
    rows = c.pipeline("addone | twice by=3").transform(df, "a", "b").collect()
    assert rows[0]["x"] == 6.0 and rows[0]["ok"] and rows[1]["x"] == 0.0
    rows = c.pipeline("twice | twice inv").transform(df, "a", "b").collect()
    assert rows[0]["x"] == 1.0 and not rows[1]["ok"] and math.isnan(rows[1]["x"])
    with pytest.raises(PipelineError):
        c.pipeline("oneway inv")


# -- GeoTIFF ----------------------------------------------------------------------------------


def packed_lzw(data):
    """Codes high bits first; the reader, who is one entry behind, widens them one code early."""
    out, n, table, width, prefix = 0, 0, {bytes([i]): i for i in range(256)}, 9, b""

    def put(code):
        nonlocal out, n
        out, n = out << width | code, n + width

    put(256)
    free = 258
    for i in range(len(data)):
        part = prefix + data[i : i + 1]
        if part in table:
            prefix = part
            continue
        put(table[prefix])
        table[part] = free
        free += 1
        width = 9 if free < 512 else 10 if free < 1024 else 11 if free < 2048 else 12
        prefix = data[i : i + 1]
        if free >= 4094:
            put(table[prefix])
            put(256)
            table, free, width, prefix = {bytes([i]): i for i in range(256)}, 258, 9, b""
    if prefix:
        put(table[prefix])
        free += 1
        width = 9 if free < 512 else 10 if free < 1024 else 11 if free < 2048 else 12
    put(257)
    pad = -n % 8
    return (out << pad).to_bytes((n + pad) // 8, "big")


def tiff(images, order="<", packing=1, planar=False, tile=None, predictor=1):
    """A file of images (values, west, north, step, metadata, area)."""
    body, heads = bytearray(b"\0" * 8), []
    for values, west, north, step, metadata, area in images:
        rows, columns, samples = values.shape
        w, h = tile or (columns, 2)
        places, sizes = [], []
        for band in range(samples) if planar else (slice(None),):
            plane = values[..., band].reshape(rows, columns, -1)
            for top in range(0, rows, h):
                for left in range(0, columns, w):
                    part = plane[top : top + h, left : left + w]
                    if tile:
                        part = np.pad(part, ((0, h - part.shape[0]), (0, w - part.shape[1]), (0, 0)))
                    if predictor == 3:
                        r, c, s = part.shape
                        bytes_ = np.ascontiguousarray(part.astype(">f4")).view(np.uint8).reshape(r, c * s, 4).transpose(0, 2, 1).reshape(r, -1, s)
                        raw = np.diff(bytes_, axis=1, prepend=np.zeros((r, 1, s), np.uint8)).astype(np.uint8).tobytes()
                    else:
                        raw = part.astype(f"{order}f4").tobytes()
                    raw = {1: lambda v: v, 5: packed_lzw, 8: zlib.compress}[packing](raw)
                    places.append(len(body))
                    sizes.append(len(raw))
                    body += raw + b"\0" * (len(raw) % 2)
        fields = [(256, "I", [columns]), (257, "I", [rows]), (258, "H", [32] * samples), (259, "H", [packing]), (277, "H", [samples]), (284, "H", [2 if planar else 1]), (317, "H", [predictor]), (339, "H", [3] * samples)]
        fields += [(322, "I", [w]), (323, "I", [h]), (324, "I", places), (325, "I", sizes)] if tile else [(273, "I", places), (278, "I", [h]), (279, "I", sizes)]
        fields += [(33550, "d", [step, step, 0.0]), (33922, "d", [0.0, 0.0, 0.0, west, north, 0.0]), (34735, "H", [1, 1, 0, 2, 1024, 0, 1, 2, 1025, 0, 1, 1 if area else 2])]
        xml = ("<GDALMetadata>" + "".join(f'<Item name="{n}"' + (f' sample="{s}" role="{r}"' if s is not None else "") + f">{v}</Item>" for n, s, r, v in metadata) + "</GDALMetadata>").encode()
        fields += [(42112, "s", xml + b"\0"), (42113, "s", b"-9999\0")]
        kinds = {"H": 3, "I": 4, "d": 12, "s": 2}
        entries = []
        for tag, code, v in sorted(fields, key=lambda x: x[0]):
            raw = bytes(v) if code == "s" else struct.pack(f"{order}{len(v)}{code}", *v)
            if len(raw) <= 4:
                held = raw.ljust(4, b"\0")
            else:
                held = struct.pack(order + "I", len(body))
                body += raw + b"\0" * (len(raw) % 2)
            entries.append(struct.pack(order + "HHI", tag, kinds[code], len(v)) + held)
        heads.append(len(body))
        body += struct.pack(order + "H", len(entries)) + b"".join(entries) + b"\0" * 4
        body += b"\0" * (len(body) % 2)
    body[:8] = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, heads[0])
    for a, b in zip(heads, heads[1:], strict=False):
        n, = struct.unpack_from(order + "H", body, a)
        struct.pack_into(order + "I", body, a + 2 + 12 * n, b)
    return bytes(body)


HORIZONTAL = [("TYPE", None, None, "HORIZONTAL_OFFSET"), ("DESCRIPTION", 0, "description", "latitude_offset"), ("DESCRIPTION", 1, "description", "longitude_offset"), ("positive_value", 1, "", "west")]


def nodes(rows, columns, west, north, step):
    lat, lon = np.meshgrid(north - step * np.arange(rows), west + step * np.arange(columns), indexing="ij")
    return np.stack((lat, -lon), axis=-1)


@pytest.mark.parametrize("options", [{}, {"order": ">"}, {"packing": 8, "predictor": 3}, {"packing": 5}, {"planar": True, "packing": 8}, {"tile": (16, 16)}, {"tile": (16, 16), "planar": True, "packing": 5}])
def test_geotiff_forms(spark, tmp_path, options):
    values = nodes(41, 37, 8.0, 58.0, 0.125)
    (tmp_path / "g.tif").write_bytes(tiff([(values, 8.0, 58.0, 0.125, HORIZONTAL, False)], **options))
    grid = gridfiles.read(spark, str(tmp_path / "g.tif"), "g.tif")
    lon, lat = np.radians([8.2, 10.33]), np.radians([57.9, 54.01])
    assert grid.kind == "horizontal" and np.allclose(grid.at(lon, lat), np.degrees(np.stack((lon, lat), axis=-1)), atol=1e-5)
    c = Context()
    c.register_grid("g", grid)
    out = c.pipeline("gridshift grids=g").arrays(lon, lat)
    assert np.allclose(np.degrees(out["x"]), np.degrees(lon) * (1 + 1 / 3600), atol=1e-7)


def test_geotiff_areas_heights_and_parts():
    flat, height = nodes(9, 9, 8.0, 58.0, 0.5), np.full((9, 9, 1), 7.0)
    height[0, 0] = -9999
    up = [("TYPE", None, None, "ELLIPSOIDAL_HEIGHT_OFFSET"), ("DESCRIPTION", 0, "description", "ellipsoidal_height_offset")]
    both = geotiff.geotiff("b", tiff([(flat, 8.0, 58.0, 0.5, HORIZONTAL, False), (height, 8.0, 58.0, 0.5, up, False)]))
    at = both.at(np.radians([10.1]), np.radians([56.2]))
    assert both.bands == 3 and np.allclose(at, [[10.1, 56.2, 7.0]], atol=1e-5)
    assert np.isnan(both.at(np.radians([8.1]), np.radians([57.9]))[0, 2])
    area = geotiff.geotiff("a", tiff([(nodes(9, 9, 8.25, 57.75, 0.5), 8.0, 58.0, 0.5, HORIZONTAL, True)]))
    assert np.allclose(area.at(np.radians([10.1]), np.radians([56.2])), [[10.1, 56.2]], atol=1e-5)
    parts = geotiff.geotiff("p", tiff([(flat, 8.0, 58.0, 0.5, HORIZONTAL, False), (nodes(9, 9, 20.0, 50.0, 0.5), 20.0, 50.0, 0.5, [], False)]))
    got = parts.at(np.radians([10.1, 21.3, 15.0]), np.radians([56.2, 48.7, 52.0]))
    assert np.allclose(got[:2], [[10.1, 56.2], [21.3, 48.7]], atol=1e-5) and np.isnan(got[2]).all()
    for broken in (b"", b"II*\0", b"nothing at all", tiff([(flat, 8.0, 58.0, 0.5, [("TYPE", None, None, "OTHER")], False)])):
        with pytest.raises((ValueError, struct.error)):
            geotiff.geotiff("x", broken)


# -- store and streams --------------------------------------------------------------------------


def test_store_maintenance(spark, tmp_path):
    store = str(tmp_path / "store")
    lat, lon = np.meshgrid(np.arange(58.0, 53.5, -1), np.arange(8.0, 16.5), indexing="ij")
    for name in ("one", "two"):
        gridstore.add(spark, gridstore.as_grid(np.stack((lon, lat), axis=-1), 58.0, 8.0, 1.0, name), store)
    assert {r["grid_id"]: r["cells"] for r in gridstore.names(spark, store).collect()} == {"one": 32, "two": 32}
    assert gridstore.remove(spark, "one", store) and not gridstore.remove(spark, "none", store)
    gridstore.vacuum(spark, store)
    assert {r["grid_id"]: r["cells"] for r in gridstore.names(spark, store).collect()} == {"two": 32}


def test_windows_of_streams_and_tables(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, rng.randint(0, 5), 1_700_000_000 + rng.randint(0, 40_000), rng.uniform(8, 16), rng.uniform(54, 58)) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, user int, s long, lon double, lat double").selectExpr("user", "timestamp_seconds(s) AS ts", "radians(lon) AS lon", "radians(lat) AS lat")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    p = Pipeline("webmerc")
    for k, make in enumerate((lambda d: centroids(d, p, "ts", "lon", "lat"), lambda d: sliding(d, p, "ts", "lon", "lat"), lambda d: sessions(d, p, "ts", "lon", "lat", "user", late="2 days"))):
        table = make(spark.read.parquet(str(tmp_path / "in")))
        source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        query = make(source).writeStream.outputMode("complete" if k < 2 else "append").format("memory").queryName(f"w{k}").trigger(availableNow=True).start()
        query.awaitTermination()
        got, want = ({tuple(r) for r in d.select("start", "n").collect()} for d in (spark.table(f"w{k}"), table))
        assert got == want if k < 2 else got <= want
    assert sum(r["n"] for r in sliding(df, p, "ts", "lon", "lat").collect()) == 600
