"""Recipes over places on the ellipsoid: nearest neighbours and lengths of routes, along geodesics. Columns lat and lon
are in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as geo
from ..functions.ellipsoid import Ellipsoid
from ..sources import scratch


def route_length(stops: DataFrame, key: str, order: list[str], ellps: str = "GRS80") -> DataFrame:
    """(key, metres, n) by key: the length of the route through its stops in order, and their number."""
    w = Window.partitionBy(key).orderBy(*order)
    legs = stops.select(key, "lat", "lon", F.lag("lat").over(w).alias("lat0"), F.lag("lon").over(w).alias("lon0"))
    legs = geo.with_geodesic(legs, "lat0", "lon0", "lat", "lon", "leg", ellps=ellps)
    leg = F.when(F.col("lat0").isNotNull(), F.col("leg")).otherwise(0.0)
    return legs.groupBy(key).agg(F.sum(leg).alias("metres"), F.count("*").alias("n"))


#: Sides of cells in space are powers of two metres: the smallest, and one that holds the globe.
LOW, HIGH = 6, 25


def _placed(df: DataFrame, ellps: Ellipsoid, *columns: Column) -> DataFrame:
    """Columns, lat and lon, and the place in space, of rows that have one."""
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    rows = df.select(*columns, number("lat").alias("lat"), number("lon").alias("lon")).filter("lat is not null and lon is not null and abs(lat) <= 90 and abs(lon) < double('Infinity')")
    xyz = ellps.cartesian(geo.Columns, F.radians("lon"), F.radians("lat"), F.lit(0.0))
    return rows.select("*", *[v.alias(n) for n, v in zip("xyz", xyz, strict=True)])


def _right(c: Column | str, bits: Column) -> Column:
    """A whole number without its last bits, rounded down."""
    return F.call_function("shiftright", F.col(c) if isinstance(c, str) else c, bits)


def _cell(level: Column) -> list[Column]:
    """The cube of a level at x, y, z, by its number along each axis."""
    return [_right(F.floor(F.col(c) + float(1 << HIGH - 1)), level) for c in "xyz"]


def k_nearest(places: DataFrame, stations: DataFrame, k: int, key: str, station: str, by: str | None = None, ellps: str = "GRS80") -> DataFrame:
    """(key, rank from 1, station, metres): for each place its k nearest stations, those of its value of `by` where that
    is named; ties to the smaller station; all of them where there are fewer.

    Places and stations are points in space, in cubes whose sides are powers of two, so poles and the date line are
    nothing special. The number of stations of every cube is counted, for all sides at once. For each place the smallest
    cube around it that holds k stations is found, and the k-th chord in it bounds how far the k-th may be; the place then
    meets the stations of cubes of about that side, its own and those around it. A chord is never longer than the geodesic, and the geodesic not
    longer than what the smallest curvature makes of the chord, so chords tell in the JVM which few pairs can be among
    the k nearest, and only those get their geodesic. There are no rounds; the work for a place follows the stations near
    it, not their number. Two tables of places are written between. Of stations at one place with one `by` only the k smallest take
    part, so a crowd at one place is no crowd of pairs.

    Rows without a key, a station, a `by` or a position take no part; so a place is left out if it has no position, or
    its `by` has no station. Places that repeat a key at one position count once.
    """
    e = Ellipsoid.named(ellps)
    group = F.col(f"`{by}`") if by else F.lit(0)
    a = _placed(places, e, F.col(f"`{key}`").alias("k"), group.alias("g")).filter("k is not null and g is not null").distinct()
    b = _placed(stations, e, F.col(f"`{station}`").alias("s"), group.alias("g")).filter("s is not null and g is not null").distinct()
    there = Window.partitionBy("g", "lat", "lon").orderBy("s")
    b = b.withColumn("n", F.row_number().over(there)).filter(F.col("n") <= k).drop("n")
    # stations by cube, of the smallest side, then of all
    axes = ("cx", "cy", "cz")
    low = [c.alias(n) for n, c in zip(axes, _cell(F.lit(LOW)), strict=True)]
    up = [_right(n, F.col("level") - LOW).alias(n) for n in axes]
    levels = F.explode(F.sequence(F.lit(LOW), F.lit(HIGH))).alias("level")
    counts = b.select("g", *low, levels).groupBy("g", "level", *[u.alias(n) for u, n in zip([_right(n, F.col("level") - LOW) for n in axes], axes, strict=True)]).agg(F.count("*").alias("n"))
    own = a.select("g", *low).distinct().select("g", *[F.col(n).alias(f"o{n}") for n in axes], *axes, levels).select("g", *[f"o{n}" for n in axes], "level", *up)
    holds = own.join(counts, ["g", "level", *axes]).groupBy("g", *[F.col(f"o{n}").alias(n) for n in axes]).agg(F.coalesce(F.min(F.when(F.col("n") >= k, F.col("level"))), F.lit(HIGH)).alias("level"))
    # no chord to one of the k is longer than the geodesic that the cube's diagonal may be
    diagonal = math.sqrt(3) * F.pow(F.lit(2.0), F.col("level"))
    curve = e.b * e.b / e.a
    longest = lambda c: F.when(c < 1e6, c * (1 + c * c / (20 * curve * curve))).otherwise(c * (1.01 * math.pi / 2 * e.a / e.b))
    a = scratch.kept(a.select("*", *low).join(holds, ["g", *axes]).drop(*axes), "places")
    at = b.select("g", "s", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), *[F.col(c).alias(f"{c}2") for c in "xyz"], *low)
    apart = F.sqrt(sum(((F.col(c) - F.col(f"{c}2")) ** 2 for c in "xyz"), F.lit(0.0)))

    def through(rows: DataFrame, level: str) -> DataFrame:
        """Pairs of rows and stations in one cube of the row's level. A station stands in a cube of each level that some
        row asks for (at most twenty)."""
        used = rows.select(level).distinct()
        met = at.join(F.broadcast(used), F.col(level).between(LOW, HIGH))
        return rows.join(met.withColumns({n: _right(n, F.col(level) - LOW) for n in axes}), ["g", level, *axes])

    # in its own cube a place has k stations: the k-th chord there bounds the k-th geodesic
    place = Window.partitionBy("k", "g", "lat", "lon")
    own = through(a.withColumns(dict(zip(axes, _cell(F.col("level")), strict=True))), "level").select("k", "g", "lat", "lon", apart.alias("within"))
    own = own.withColumn("n", F.row_number().over(place.orderBy("within"))).filter(F.col("n") == k).drop("n")
    a = a.join(own, ["k", "g", "lat", "lon"], "left").withColumn("reach", longest(F.coalesce("within", diagonal))).drop("within")
    side = F.least(F.lit(HIGH), F.greatest(F.lit(LOW), F.ceil(F.log2(F.col("reach") + 0.001)))).cast("int")
    # read again and again below, and long to plan
    a = scratch.kept(a.withColumn("side", side).select("k", "g", "lat", "lon", "x", "y", "z", "reach", "side"), "places")
    steps = [F.array(*[c + i for i in (-1, 0, 1)]) for c in _cell(F.col("side"))]
    a = a.select("*", F.explode(steps[0]).alias("cx"), steps[1].alias("ys"), steps[2].alias("zs"))
    a = a.select("*", F.explode("ys").alias("cy")).select("*", F.explode("zs").alias("cz")).drop("ys", "zs")
    pairs = through(a, "side").withColumn("chord", apart).filter("chord <= reach + 0.001")
    known = F.nth_value("chord", k).over(place.orderBy("chord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    few = pairs.select("k", "g", "lat", "lon", "s", "lat2", "lon2", "chord", known.alias("kth")).filter(F.col("kth").isNull() | (F.col("chord") <= longest(F.col("kth")) + 0.001))
    # about k pairs a place are left: one Arrow hop for them keeps the plan short, which is planned anew after each stage
    metres = F.nanvl(geo.distance("lat", "lon", "lat2", "lon2", ellps), F.lit(None))
    # a geodesic that doesn't converge is nearly half the globe long
    few = few.select("k", "g", "lat", "lon", "s", F.coalesce(metres, F.lit(2.0e7)).alias("metres"))
    ranked = few.withColumn("rank", F.row_number().over(place.orderBy("metres", "s"))).filter(F.col("rank") <= k)
    return ranked.select(F.col("k").alias(key), "rank", F.col("s").alias(station), "metres")


def nearest(places: DataFrame, stations: DataFrame, key: str, station: str, by: str | None = None, ellps: str = "GRS80") -> DataFrame:
    """(key, station, metres): for each place the nearest station; see k_nearest."""
    return k_nearest(places, stations, 1, key, station, by, ellps).drop("rank")
