"""Column functions. `from geoquill.functions import columns as geo`, then `geo.distance(...)` in any select or
aggregation.

Angles are in degrees and lengths in metres. Closed formulas are ordinary expressions of Spark's own functions, compiled
with the rest of the plan. Geodesics take many named steps: `with_geodesic` adds them to a table as generated code;
`distance`, `azimuth` and `destination`, for use within any expression, run on Arrow batches. Where they don't converge
(near antipodes), and for null or NaN, they are null.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.text import number
from . import ellipsoid, geodesics
from .ellipsoid import Ellipsoid
from .mathx import E, Sql

Value = Column | str | float | int


def _c(v: Value) -> Column:
    return v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(float(v))


class Columns:
    """The elementary functions over Spark columns."""

    @staticmethod
    def let(*values):
        return list(values) if len(values) > 1 else values[0]

    @staticmethod
    def where(c, a, b):
        return F.when(c, a).otherwise(b)

    isnan, log, log1p, floor, asinh, power, atan2, hypot = (staticmethod(f) for f in (F.isnan, F.log, F.log1p, F.floor, F.asinh, F.pow, F.atan2, F.hypot))
    sin, cos, tan, asin, acos, atan, sinh, cosh, tanh, atanh, exp, sqrt, abs, sign = (staticmethod(f) for f in (F.sin, F.cos, F.tan, F.asin, F.acos, F.atan, F.sinh, F.cosh, F.tanh, F.atanh, F.exp, F.sqrt, F.abs, F.signum))


def _ellps(name: str) -> Ellipsoid:
    return Ellipsoid.named(name)


# -- shape and curvature ----------------------------------------------------------------------


def prime_vertical(lat: Value, ellps: str = "GRS80") -> Column:
    """Radius of curvature across the meridian."""
    return _ellps(ellps).prime_vertical(Columns, F.radians(_c(lat)))


def meridian(lat: Value, ellps: str = "GRS80") -> Column:
    """Radius of curvature along the meridian."""
    return _ellps(ellps).meridian(Columns, F.radians(_c(lat)))


def gaussian_radius(lat: Value, ellps: str = "GRS80") -> Column:
    return F.sqrt(prime_vertical(lat, ellps) * meridian(lat, ellps))


def mean_radius(lat: Value, ellps: str = "GRS80") -> Column:
    n, m = prime_vertical(lat, ellps), meridian(lat, ellps)
    return 2 * n * m / (n + m)


def azimuthal_radius(lat: Value, azimuth: Value, ellps: str = "GRS80") -> Column:
    """Euler's formula."""
    s, n, m = F.sin(F.radians(_c(azimuth))), prime_vertical(lat, ellps), meridian(lat, ellps)
    return n * m / (m * s * s + n * (1 - s * s))


# -- latitudes --------------------------------------------------------------------------------

LATITUDES = ("geocentric", "reduced", "conformal", "authalic", "rectifying")


def latitude(lat: Value, kind: str, ellps: str = "GRS80", inverse: bool = False) -> Column:
    """A geographic latitude as one of LATITUDES, or back."""
    e, phi = _ellps(ellps), F.radians(_c(lat))
    if kind in ("geocentric", "reduced"):
        f = getattr(e, f"from_{kind}" if inverse else kind)
        return F.degrees(f(Columns, phi))
    if kind not in LATITUDES:
        raise ValueError(f"kind is one of {', '.join(LATITUDES)}")
    return F.degrees(e.along(Columns, getattr(e, kind)[int(inverse)], phi))


def isometric(lat: Value, ellps: str = "GRS80") -> Column:
    """Isometric latitude, in radians."""
    return _ellps(ellps).isometric(Columns, F.radians(_c(lat)))


def from_isometric(psi: Value, ellps: str = "GRS80") -> Column:
    """Geographic latitude of an isometric one: the conformal latitude's series, inverted."""
    e = _ellps(ellps)
    return F.degrees(e.along(Columns, e.conformal[1], F.atan(F.sinh(_c(psi)))))


def meridian_distance(lat: Value, ellps: str = "GRS80") -> Column:
    """Length of the meridian from the equator."""
    return _ellps(ellps).arc(Columns, F.radians(_c(lat)))


def latitude_of_distance(metres: Value, ellps: str = "GRS80") -> Column:
    return F.degrees(_ellps(ellps).lat_of_arc(Columns, _c(metres)))


# -- cartesian coordinates --------------------------------------------------------------------


def cartesian(lon: Value, lat: Value, height: Value = 0.0, ellps: str = "GRS80") -> Column:
    """struct<x, y, z>, geocentric."""
    xyz = _ellps(ellps).cartesian(Columns, F.radians(_c(lon)), F.radians(_c(lat)), _c(height))
    return F.struct(*[v.alias(n) for n, v in zip("xyz", xyz, strict=True)])


def geographic(x: Value, y: Value, z: Value, ellps: str = "GRS80") -> Column:
    """struct<lon, lat, height> of geocentric coordinates."""
    e = _ellps(ellps)

    @F.pandas_udf("lon double, lat double, height double")
    def run(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.DataFrame:
        with np.errstate(all="ignore"):
            lon, lat, h = e.geographic(ellipsoid.Np, *(np.asarray(v, float) for v in (x, y, z)))
        return pd.DataFrame({"lon": np.degrees(lon), "lat": np.degrees(lat), "height": h})

    return run(_c(x), _c(y), _c(z))


# -- gravity ----------------------------------------------------------------------------------


def gravity(lat: Value, height: Value = 0.0, model: str = "grs80") -> Column:
    """Normal gravity by cassinis, jeffreys, grs67, grs80 or welmec, in m/s2."""
    return ellipsoid.gravity(Columns, model, F.radians(_c(lat)), _c(height))


def somigliana(lat: Value, ellps: str = "GRS80") -> Column:
    """Normal gravity on the ellipsoid by the closed formula."""
    return ellipsoid.somigliana(Columns, _ellps(ellps), F.radians(_c(lat)))


# -- geodesics --------------------------------------------------------------------------------


def _inverse(lat1: Value, lon1: Value, lat2: Value, lon2: Value, ellps: str, which: int) -> Column:
    e = _ellps(ellps)

    @F.pandas_udf("double")
    def run(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
        out = geodesics.inverse(e, *(np.radians(np.asarray(v, float)) for v in (lon1, lat1, lon2, lat2)))[which]
        return pd.Series(out if which == 2 else np.degrees(out))

    return run(*(F.coalesce(_c(v).cast("double"), F.lit(math.nan)) for v in (lat1, lon1, lat2, lon2)))


def distance(lat1: Value, lon1: Value, lat2: Value, lon2: Value, ellps: str = "GRS80") -> Column:
    """Length of the geodesic."""
    return _inverse(lat1, lon1, lat2, lon2, ellps, 2)


def azimuth(lat1: Value, lon1: Value, lat2: Value, lon2: Value, ellps: str = "GRS80") -> Column:
    """Direction of the geodesic at its start, clockwise from north."""
    return _inverse(lat1, lon1, lat2, lon2, ellps, 0)


def destination(lat: Value, lon: Value, azimuth: Value, metres: Value, ellps: str = "GRS80") -> Column:
    """struct<lat, lon, azimuth> at the end of a geodesic."""
    e = _ellps(ellps)

    @F.pandas_udf("lat double, lon double, azimuth double")
    def run(lat: pd.Series, lon: pd.Series, azimuth: pd.Series, metres: pd.Series) -> pd.DataFrame:
        u, v, w = geodesics.direct(e, *(np.radians(np.asarray(c, float)) for c in (lon, lat, azimuth)), np.asarray(metres, float))
        return pd.DataFrame({"lat": np.degrees(v), "lon": np.degrees(u), "azimuth": np.degrees(w)})

    return run(*(F.coalesce(_c(v).cast("double"), F.lit(math.nan)) for v in (lat, lon, azimuth, metres)))


def with_geodesic(df: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str, metres: str | None = "metres", azimuth: str | None = None, back: str | None = None, ellps: str = "GRS80") -> DataFrame:
    """df with the length of the geodesic between two places in columns of degrees, its direction at the start, and that
    at the end, under the names given. All of it is generated code in the JVM, whatever the number of rows (points near
    antipodes go on in a loop without); null where nothing converges, and for null or NaN."""
    m = Sql("_between")
    rad = math.pi / 180
    a, b, c, d = m.let(*(E(f"coalesce(double(`{n}`), double('NaN'))") * rad for n in (lon1, lat1, lon2, lat2)))
    az1, az2, s = geodesics.inverse_in(m, _ellps(ellps), a, b, c, d)
    made = {n: f"nanvl({v.s}, null){'' if v is s else ' * ' + repr(180 / math.pi) + 'D'}" for n, v in ((metres, s), (azimuth, az1), (back, az2)) if n}
    kept = [f"`{x}`" for x in df.columns if x not in made]
    df = m.named(df)
    # one struct, so that filters on the result don't write the formulas out again
    return df.selectExpr(*kept, "inline(array(named_struct(" + ", ".join(f"'{n}', {v}" for n, v in made.items()) + ")))")


# -- angles and plane geometry ----------------------------------------------------------------


def angle(text: Value) -> Column:
    """Degrees of d, d:m or d:m:s with a sign or a trailing N, S, E, W."""
    return number(_c(text))


def dms(degrees: Value) -> Column:
    """Degrees as packed DDDMMSS.sss."""
    v = _c(degrees)
    size = F.abs(v)
    d = F.floor(size)
    m = F.floor((size - d) * 60)
    return F.signum(v) * (d * 10000 + m * 100 + ((size - d) * 60 - m) * 60)


def from_dms(packed: Value) -> Column:
    v = _c(packed)
    size = F.abs(v)
    d = F.floor(size / 10000)
    m = F.floor((size - d * 10000) / 100)
    return F.signum(v) * (d + m / 60 + (size - d * 10000 - m * 100) / 3600)


def intersection(ax: Value, ay: Value, bx: Value, by: Value, cx: Value, cy: Value, dx: Value, dy: Value, near: float = 1e-9) -> Column:
    """Common points of the segments ab and cd as array<struct<x, y>>: none, one, or the two ends of a common part.
    Ends within `near` count as equal; a segment may be a point."""
    a, b, c, d = ((_c(x).cast("double"), _c(y).cast("double")) for x, y in ((ax, ay), (bx, by), (cx, cy), (dx, dy)))
    cross = lambda o, p, q: (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    none = F.array().cast("array<struct<x:double,y:double>>")
    flat = lambda v: F.abs(v) < near

    def between(p, o, q):
        """Of a point on the line oq: whether it lies within the segment."""
        return (p[0] >= F.least(o[0], q[0]) - near) & (p[0] <= F.greatest(o[0], q[0]) + near) & (p[1] >= F.least(o[1], q[1]) - near) & (p[1] <= F.greatest(o[1], q[1]) + near)

    # one line: the ends that lie within the other segment, each place once
    ends = F.filter(F.array(*[F.when(between(p, o, q), point(p)) for p, o, q in ((c, a, b), (d, a, b), (a, c, d), (b, c, d))]), lambda p: p.isNotNull())
    apart = lambda p, q: (F.abs(p["x"] - q["x"]) >= near) | (F.abs(p["y"] - q["y"]) >= near)
    distinct = F.aggregate(ends, none, lambda kept, p: F.when(F.exists(kept, lambda q: ~apart(p, q)), kept).otherwise(F.concat(kept, F.array(p))))
    same_line = flat(cross(a, b, c)) & flat(cross(a, b, d)) & flat(cross(c, d, a)) & flat(cross(c, d, b))
    # two lines: where they cross, if both segments reach it
    bend = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
    t = F.try_divide((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0]), bend)
    place = (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
    met = t.isNotNull() & between(place, a, b) & between(place, c, d)
    return F.when(same_line, distinct).when(met, F.array(point(place))).otherwise(none)
