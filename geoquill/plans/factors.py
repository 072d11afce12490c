"""Map factors of a projection: scales, distortion, convergence, Tissot's ellipse, from exact derivatives."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dual import D, Dual, dual
from ..functions.ellipsoid import Ellipsoid
from ..functions.mathx import E, Sql, wrap
from .pipeline import Pipeline

NAMES = ("meridional_scale", "parallel_scale", "areal_scale", "angular_distortion", "meridian_parallel_angle", "meridian_convergence", "tissot_semimajor", "tissot_semiminor")
SLOPES = ("_xl", "_yl", "_xp", "_yp")


def factors(df: DataFrame, pipeline: Pipeline, lon: str, lat: str, ellps: str = "GRS80", step: float = 1e-5) -> DataFrame:
    """All columns of df and NAMES; lon and lat in radians. Angular distortion is in radians, the other angles are in
    degrees; all are NaN where the projection fails.

    The pipeline is compiled once, for values with their derivatives (see functions.dual). Pipelines with operators that
    iterate on arrays or look up in grids have no such form: theirs are differences over `step` around each point."""
    e = Ellipsoid.named(ellps)
    kept = [f"`{c}`" for c in df.columns]
    out = _differences(df, pipeline, lon, lat, step) if any(op is not None and (op.arrow or op.stored) for op in pipeline.ops) else _derivatives(df, pipeline, lon, lat)
    # metres of the map by metre along the parallel (a, c) and along the meridian (b, d)
    out = out.withColumns({"_cos": F.cos(lat), "_w": 1 - e.es * F.sin(lat) * F.sin(lat)})
    east, north = F.sqrt("_w") / (e.a * F.col("_cos")), F.col("_w") * F.sqrt("_w") / (e.a * (1 - e.es))
    out = out.select(*kept, *[(F.col(s) * f).alias(n) for n, s, f in (("_a", "_xl", east), ("_c", "_yl", east), ("_b", "_xp", north), ("_d", "_yp", north))])
    a, b, c, d = (F.col(f"_{n}") for n in "abcd")
    # sum and difference of Tissot's axes, without cancellation: a conformal map has no difference
    out = out.withColumns({"_sum": F.hypot(a + d, b - c), "_difference": F.hypot(a - d, b + c), "_h": F.hypot(b, d), "_k": F.hypot(a, c), "_s": a * d - b * c})
    whole, rest, h, k, s = (F.col(n) for n in ("_sum", "_difference", "_h", "_k", "_s"))
    return out.select(
        *kept, h.alias(NAMES[0]), k.alias(NAMES[1]), s.alias(NAMES[2]), (2 * F.asin(rest / whole)).alias(NAMES[3]), F.when(F.isnan(s), s).otherwise(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s / (h * k)))) * (180 / math.pi)).alias(NAMES[4]),
        (-F.atan2(b, d) * (180 / math.pi)).alias(NAMES[5]), ((whole + rest) / 2).alias(NAMES[6]), ((whole - rest) / 2).alias(NAMES[7]),
    )


def _derivatives(df: DataFrame, pipeline: Pipeline, lon: str, lat: str) -> DataFrame:
    m = Sql("_f")
    start = m.let(*(E(f"coalesce(double(`{c}`), double('NaN'))") for c in (lon, lat)))
    (x, y, *_), good = pipeline.run(Dual(m), D(start[0], 1.0, 0.0), D(start[1], 0.0, 1.0), 0.0, math.nan)
    x, y = dual(x), dual(y)
    every = " AND ".join(wrap(g).s for _, g in good)
    made = {n: f"if({every}, {wrap(v).s}, double('NaN'))" for n, v in zip(SLOPES, (x.x, y.x, x.y, y.y), strict=True)}
    return m.named(df).selectExpr(*[f"`{c}`" for c in df.columns], "inline(array(named_struct(" + ", ".join(f"'{n}', {v}" for n, v in made.items()) + ")))")


def _differences(df: DataFrame, pipeline: Pipeline, lon: str, lat: str, step: float) -> DataFrame:
    """By the four corners around a point, in one projection."""
    out, corner = df, {}
    for k, (i, j) in enumerate(((1, 1), (1, -1), (-1, -1), (-1, 1))):
        out = out.withColumn("_lon", F.col(lon) + i * step).withColumn("_lat", F.col(lat) + j * step)
        out = pipeline.transform(out, "_lon", "_lat", into=(f"_x{k}", f"_y{k}", "_z", "_t"), ok=None)
        corner[k] = (F.col(f"_x{k}"), F.col(f"_y{k}"))
    slope = lambda axis, signs: sum((s * corner[k][axis] for k, s in enumerate(signs)), F.lit(0.0)) / (4 * step)
    return out.select(*[f"`{c}`" for c in df.columns], *[slope(axis, signs).alias(n) for n, (axis, signs) in zip(SLOPES, ((0, (1, 1, -1, -1)), (1, (1, 1, -1, -1)), (0, (1, -1, -1, 1)), (1, (1, -1, -1, 1))), strict=True)])
