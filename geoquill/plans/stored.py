"""Steps over stored grids: lookups are joins, so a grid may be of any size and never meets the driver.

A point is given its grid, row and column from the heads (one broadcast row, with an item for each grid named in the
step), and meets its cell by an equality join. Points outside of all grids are spread over made-up keys, so that they
crowd no task. Points of a busy cell meet it in a skewed join, which Spark splits.

Inverse shifts are fixed points. Within a cell the shift is one formula, so a round follows it there until it stands
still; only points that have come into another cell, or under another grid, join again, from a written table, for ten
rounds at most (ten is also what the form on arrays allows). What hasn't come to rest then fails.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import Columns
from ..functions.mathx import E, Sql, wrapped
from ..sources import griddata, gridstore, scratch
from ..sources.gridcache import Handle, InFile

EPS, ROUNDS = 1e-12, 10
AT = "_at"


def nan() -> Column:
    return F.lit(math.nan)


def tuple_() -> list[Column]:
    return [F.col(f"_p{k}") for k in range(4)]


@dataclass
class Stored:
    """A grid in a store, by what its head tells."""

    name: str
    store: str
    kind: str
    bands: int
    projected: bool


def find(spark: SparkSession, store: str, name: str) -> Stored | None:
    row = gridstore.known(spark, store).filter((F.col("grid_id") == name) & F.col("top")).select("kind", "bands", "projected").first()
    return row and Stored(name, store, row["kind"], row["bands"], row["projected"])


class Tables:
    """Heads and cells of the grids of a step, in order of preference."""

    def __init__(self, grids: list, null: bool):
        self.grids, self.null = grids, null

    def _rows(self, spark: SparkSession, grid: object, what: str) -> DataFrame:
        if isinstance(grid, Stored):
            rows = gridstore.known(spark, grid.store) if what == "heads" else gridstore.table(spark, grid.store)
            return rows.filter((F.col("grid_id") == grid.name) | F.col("grid_id").rlike(f"^{re.escape(grid.name)}/[0-9]+$"))
        if isinstance(grid, InFile):
            return griddata.rows_of(spark, grid._path, grid._name, what)
        held = grid.grid() if isinstance(grid, Handle) else grid
        return gridstore.heads(spark, held) if what == "heads" else gridstore.cells(spark, held)

    def heads(self, spark: SparkSession) -> DataFrame:
        """One row: all heads, by preference, then the parts that take precedence."""
        out = None
        for k, grid in enumerate(self.grids):
            rows = self._rows(spark, grid, "heads").select(F.struct(F.lit(k).alias("order"), (-F.col("part")).alias("before"), "top", "grid_id", "part", "north", "west", "dlat", "dlon", "rows", "cols").alias("g"))
            out = rows if out is None else out.unionByName(rows)
        return out.agg(F.collect_list("g").alias("_heads"))

    def cells(self, spark: SparkSession) -> DataFrame:
        names = ("part", "row", "col", "nw", "ne", "sw", "se")
        out = None
        for k, grid in enumerate(self.grids):
            rows = self._rows(spark, grid, "cells").select(F.lit(k).alias("_order"), *[F.col(n).alias(f"_{n}") for n in names])
            out = rows if out is None else out.unionByName(rows)
        return out

    def place(self, df: DataFrame, x: Column, y: Column, into: str = AT) -> DataFrame:
        """df with a struct of the grid and cell at (x, y), null outside: of the grids that hold the point, else of
        those within half a cell of it."""

        def around(margin: float) -> Callable[[Column], Column]:
            def test(g: Column) -> Column:
                u, v = margin * g["dlon"] + EPS, margin * g["dlat"] + EPS
                east, south = g["west"] + (g["cols"] - 1) * g["dlon"], g["north"] - (g["rows"] - 1) * g["dlat"]
                whole = g["top"] & (x >= g["west"] - u) & (x <= east + u) & (y <= g["north"] + v) & (y >= south - v)
                if margin:
                    return whole
                return whole | ~g["top"] & (x >= g["west"] - EPS) & (x < east - EPS) & (y < g["north"] - EPS) & (y >= south - EPS)

            return test

        g = F.coalesce(F.array_min(F.filter("_heads", around(0.0))), F.array_min(F.filter("_heads", around(0.5))))
        df = df.crossJoin(F.broadcast(self.heads(df.sparkSession))).withColumn("_head", F.when(~(F.isnan(x) | F.isnan(y)), g)).drop("_heads")
        h = F.col("_head")
        row, col = gridstore.place(-y, -h["north"], h["dlat"], h["rows"]), gridstore.place(x, h["west"], h["dlon"], h["cols"])
        at = F.struct(h["order"].alias("order"), h["part"].alias("part"), row.alias("row"), col.alias("col"), *[h[n].alias(n) for n in ("north", "west", "dlat", "dlon")])
        return df.withColumn(into, F.when(h.isNotNull(), at)).drop("_head")

    def met(self, df: DataFrame, x: Column, y: Column) -> DataFrame:
        """df with AT, and the corner values nw, ne, sw, se of the cell there."""
        df = self.place(df, x, y)
        at = F.col(AT)
        away = -1 - F.pmod(F.xxhash64(x, y), F.lit(1 << 20)).cast("int")
        df = df.withColumns({"_order": F.coalesce(at["order"], F.lit(-1)), "_part": F.coalesce(at["part"], F.lit(-1)), "_row": F.coalesce(at["row"], away), "_col": F.coalesce(at["col"], F.lit(-1))})
        return df.join(self.cells(df.sparkSession), ["_order", "_part", "_row", "_col"], "left").drop("_order", "_part", "_row", "_col")

    def value(self, x: Column, y: Column, band: int) -> Column:
        """Bilinear; outside of all grids NaN, or 0 with the null grid."""
        at = F.col(AT)
        u, v = (x - at["west"]) / at["dlon"] - at["col"], (at["north"] - y) / at["dlat"] - at["row"]
        n = {c: F.col(f"_{c}")[band] for c in ("nw", "ne", "sw", "se")}
        inside = (1 - v) * ((1 - u) * n["nw"] + u * n["ne"]) + v * ((1 - u) * n["sw"] + u * n["se"])
        return F.when(at.isNotNull(), F.coalesce(inside, nan())).otherwise(F.lit(0.0) if self.null else nan())


CORNERS = (AT, "_nw", "_ne", "_sw", "_se")


def computed(df: DataFrame, make: Callable) -> DataFrame:
    """df with columns made by `make(m, p0, .. p3)`, a dict of names and values in terms of the functions m."""
    m = Sql("_d")
    made = make(m, *[E(f"_p{k}") for k in range(4)])
    names = [n for stage in m.stages for n, _ in stage]
    out = m.named(df)
    kept = [c for c in df.columns if c not in made]
    return out.selectExpr(*[f"`{c}`" for c in kept], *[f"{v.s} AS `{n}`" for n, v in made.items()]).drop(*names)


class Shift:
    """gridshift over stored grids: see operators.grids for what it does."""

    def __init__(self, tables: Tables, kind: str, bands: int, projected: bool, flat: bool):
        self.tables, self.bands, self.projected = tables, bands, projected
        self.unit = 1.0 if projected else math.pi / 180 / 3600
        self.sign = 1.0 if kind in ("vertical", "ellipsoidal") and not flat else -1.0
        self.heights = bands > 2 and not flat

    def _level(self, lon: Column) -> Column:
        return lon if self.projected else wrapped(Columns, lon)

    def apply(self, df: DataFrame, back: bool) -> DataFrame:
        x, y, z, _ = tuple_()
        if self.bands == 1 or not back:
            df = self.tables.met(df, x, y)
            v = [self.tables.value(x, y, k) for k in range(self.bands)]
            if self.bands == 1:
                made = {"_p0": (x if back else self._level(x)) + v[0] * 0, "_p1": y + v[0] * 0, "_p2": z + (-self.sign if back else self.sign) * v[0]}
            else:
                made = {"_p0": self._level(x + v[0] * self.unit), "_p1": y + v[1] * self.unit} | ({"_p2": z + v[2]} if self.heights else {})
            return df.withColumns(made).drop(*CORNERS)
        return self._inverse(df)

    def _inverse(self, df: DataFrame) -> DataFrame:
        if df.isStreaming:
            raise ValueError("the inverse over stored grids is for tables, not for streams")
        x, y, z, _ = tuple_()
        columns = df.columns
        df = df.withColumns({"_u": x, "_v": y})
        done = None
        for turn in range(ROUNDS):
            df = self.tables.met(df, F.col("_u"), F.col("_v"))
            value = lambda s, k: self.tables.value(s["u"], s["v"], k) * self.unit

            def step(s: Column, _: Column) -> Column:
                a, b = x - value(s, 0), y - value(s, 1)
                return F.when(s["moved"] < EPS, s).otherwise(F.struct(a.alias("u"), b.alias("v"), F.hypot(a - s["u"], b - s["v"]).alias("moved")))  # noqa: B023

            start = F.struct(F.col("_u").alias("u"), F.col("_v").alias("v"), F.lit(math.inf).alias("moved"))
            df = df.withColumn("_s", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step))
            s = F.col("_s")
            df = df.withColumns({"_z": z - self.tables.value(s["u"], s["v"], 2) if self.heights else z, "_u": s["u"], "_v": s["v"], "_moved": s["moved"]}).drop("_s", "_nw", "_ne", "_sw", "_se")
            # at rest in the cell that was asked, or nothing more to find
            df = self.tables.place(df.withColumnRenamed(AT, "_was"), F.col("_u"), F.col("_v"))
            key = lambda c: F.struct(*[F.col(c)[n].alias(n) for n in ("order", "part", "row", "col")])
            same = F.when(F.col(AT).isNull() | F.col("_was").isNull(), F.col(AT).isNull() & F.col("_was").isNull()).otherwise(key(AT) == key("_was"))
            lost = F.isnan("_u") | F.isnan("_v")
            df = scratch.kept(df.withColumns({"_rest": same & (F.col("_moved") < EPS), "_lost": lost}).drop(AT, "_was", "_moved"), "shift")
            settled = df.filter("_rest or _lost")
            done = settled if done is None else done.unionByName(settled)
            df = df.filter("not (_rest or _lost)").drop("_rest", "_lost", "_z")
            if turn == ROUNDS - 1 or df.isEmpty():
                break
        rest = df.withColumns({"_z": z, "_rest": F.lit(False), "_lost": F.lit(True)})
        good = F.col("_rest")
        made = {"_p0": F.when(good, F.col("_u")).otherwise(nan()), "_p1": F.when(good, F.col("_v")).otherwise(nan()), "_p2": F.when(good, F.col("_z")).otherwise(z)}
        return done.unionByName(rest).withColumns(made).select(*columns)


class Velocity:
    """deformation over stored grids."""

    def __init__(self, tables: Tables, ellps, dt: float, epoch: float, raw: bool):
        self.tables, self.ellps, self.dt, self.epoch, self.raw = tables, ellps, dt, epoch, raw

    def apply(self, df: DataFrame, back: bool) -> DataFrame:
        columns = df.columns
        df = computed(df, lambda m, x, y, z, t: dict(zip(("_lon", "_lat"), m.let(*self.ellps.geographic(m, x, y, z)[:2]), strict=True)))
        lon, lat = F.col("_lon"), F.col("_lat")
        df = self.tables.met(df, lon, lat)
        span = F.lit(self.dt) if math.isfinite(self.dt) else F.col("_p3") - self.epoch
        east, north, up = (self.tables.value(lon, lat, k) * (-0.001 if back else 0.001) * span for k in range(3))
        df = df.withColumns({"_east": east, "_north": north, "_up": up}).drop(*CORNERS)
        e, n, u = F.col("_east"), F.col("_north"), F.col("_up")
        sl, cl, sp, cp = F.sin(lon), F.cos(lon), F.sin(lat), F.cos(lat)
        d = (-sl * e - sp * cl * n + cp * cl * u, cl * e - sp * sl * n + cp * sl * u, cp * n + sp * u)
        if self.raw:
            made = {"_p0": d[0], "_p1": d[1], "_p2": d[2], "_p3": F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])}
        else:
            made = {f"_p{k}": F.col(f"_p{k}") + d[k] for k in range(3)}
        return df.withColumns(made).select(*columns)


class Deflection:
    """deflection over a stored geoid: the point and its neighbours a metre north and east each meet their cell."""

    def __init__(self, tables: Tables, ellps):
        self.tables, self.ellps = tables, ellps

    def apply(self, df: DataFrame, back: bool) -> DataFrame:
        columns, e, rad = df.columns, self.ellps, math.pi / 180

        def places(m, x, y, z, t):
            lat, lon = m.let(x * rad, y * rad)
            return {"_lat": lat, "_lon": lon, "_up": m.let(e.lat_of_arc(m, e.arc(m, lat) + 1.0)), "_right": m.let(lon + 1 / (m.cos(lat) * e.prime_vertical(m, lat)))}

        df = computed(df, places)
        for name, x, y in (("_n", "_lon", "_lat"), ("_a", "_lon", "_up"), ("_b", "_right", "_lat")):
            df = self.tables.met(df, F.col(x), F.col(y)).withColumn(name, self.tables.value(F.col(x), F.col(y), 0)).drop(*CORNERS)
        second = rad / 3600
        return df.withColumns({"_p0": F.atan(F.col("_a") - F.col("_n")) / second, "_p1": F.atan(F.col("_b") - F.col("_n")) / second}).select(*columns)
