"""Routes that grow: of each key, the legs between its places in order of time and their length so far.

Of a table it is a window. Of a stream the state of a key is its last place with what it has come to, and the rows that
still wait: a row is final once the watermark has passed it, and rows that came in another order are put in order by
then. Rows behind the watermark are late, and Spark drops them. A timer for the earliest waiting row wakes the key. A route
ends where nothing follows for `idle`, and the key begins anew; a stream forgets such keys by another timer. State is in RocksDB, so it isn't
bounded by memory, and survives a restart with the query's checkpoint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import columns as geo
from ..functions import geodesics
from ..functions.ellipsoid import Ellipsoid

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Route(StatefulProcessor):
    def __init__(self, key: str, time: str, ellps: str, idle: int | None):
        self.key, self.time, self.ellps, self.idle = key, time, ellps, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "micros long, lat double, lon double, metres double, n long")
        self.waiting = handle.getListState("waiting", "micros long, id long, lat double, lon double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            batch.columns = [self.key, self.time, "_id", "lat", "lon"]  # names that begin with _ don't come through
            micros = batch[self.time].astype("datetime64[us]").astype("int64")
            self.waiting.appendList([(int(t), int(i), float(a), float(b)) for t, i, a, b in zip(micros, batch["_id"], batch["lat"], batch["lon"], strict=True)])
        self._wake()
        yield pd.DataFrame()

    def _wake(self) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        first = min((t for t, *_ in self.waiting.get()), default=None) if self.waiting.exists() else None
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        elif self.idle is not None and self.last.exists():
            self.handle.registerTimer((self.last.get()[0] + self.idle) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        every = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due, rest = [r for r in every if r[0] < mark], [r for r in every if r[0] >= mark]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        out = pd.DataFrame()
        if due:
            before = tuple(self.last.get()) if self.last.exists() else None
            t, i, lat, lon = (np.array(c) for c in zip(*due, strict=True))
            t0 = np.concatenate(([before[0] if before else t[0]], t[:-1]))
            lat0, lon0 = np.concatenate(([before[1] if before else math.nan], lat[:-1])), np.concatenate(([before[2] if before else math.nan], lon[:-1]))
            legs = geodesics.inverse(Ellipsoid.named(self.ellps), *(np.radians(v) for v in (lon0, lat0, lon, lat)))[2]
            fresh = t - t0 > self.idle if self.idle is not None else np.zeros(len(t), bool)
            legs = np.where(np.isfinite(legs) & ~fresh, legs, 0.0)
            # sums and counts since the route began, in this batch or before
            begun = np.maximum.accumulate(np.where(fresh, np.arange(len(t)), -1))
            sums, places = np.cumsum(legs), np.arange(1, len(t) + 1)
            metres = sums - np.where(begun >= 0, sums[begun], -(before[3] if before else 0.0))
            n = places - np.where(begun >= 0, begun, -(before[4] if before else 0))
            self.last.update((int(t[-1]), float(lat[-1]), float(lon[-1]), float(metres[-1]), int(n[-1])))
            out = pd.DataFrame({self.key: key[0], self.time: pd.to_datetime(t, unit="us"), "id": i, "leg": legs, "metres": metres, "n": n})
        elif not every and self.last.exists() and self.idle is not None and self.last.get()[0] + self.idle < mark:
            self.last.clear()
        self._wake()
        yield out

    def close(self) -> None:
        pass


def routes(places: DataFrame, key: str, time: str, id: str = "id", late: str = "1 hour", idle: str | None = None, ellps: str = "GRS80") -> DataFrame:
    """(key, time, id, leg, metres, n) for each place: metres from the key's place before it (0 for the first), metres so
    far, and the number of places so far, in order of time, then of the whole number `id`. Columns lat and lon are in
    degrees. Rows without a key, a time, an id or a position are left out; a leg that doesn't converge counts as 0.

    After a gap of more than `idle` (such as "30 minutes") a route begins anew. `places` may be a stream; then places
    within `late` may come in any order."""
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c)
    rows = places.select(F.col(f"`{key}`"), F.col(f"`{time}`"), F.col(f"`{id}`").cast("long").alias("_id"), number("lat"), number("lon")).dropna()
    forget = int(pd.Timedelta(idle).total_seconds() * 1_000_000) if idle else None
    if not rows.isStreaming:
        w = Window.partitionBy(key).orderBy(time, "_id", "lat", "lon")
        gap = F.unix_micros(F.col(f"`{time}`").cast("timestamp")) - F.lag(F.unix_micros(F.col(f"`{time}`").cast("timestamp"))).over(w)
        fresh = F.coalesce(gap > forget, F.lit(False)) if forget is not None else F.lit(False)
        legs = rows.select("*", F.lag("lat").over(w).alias("lat0"), F.lag("lon").over(w).alias("lon0"), fresh.alias("_fresh"))
        legs = geo.with_geodesic(legs, "lat0", "lon0", "lat", "lon", "leg", ellps=ellps)
        legs = legs.withColumn("leg", F.when(F.col("_fresh"), 0.0).otherwise(F.coalesce("leg", F.lit(0.0))))
        if forget is not None:
            legs = legs.withColumn("_route", F.sum(F.col("_fresh").cast("long")).over(w))
            w = Window.partitionBy(key, "_route").orderBy(time, "_id", "lat", "lon")
        return legs.select(key, time, F.col("_id").alias("id"), "leg", F.sum("leg").over(w).alias("metres"), F.row_number().over(w).cast("long").alias("n"))
    spark = rows.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKS:
        raise ValueError(f"set {PROVIDER} to {ROCKS}: the state of routes has lists and timers")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, time)}
    schema = f"`{key}` {kinds[key]}, `{time}` {kinds[time]}, id long, leg double, metres double, n long"
    return rows.withWatermark(time, late).groupBy(key).transformWithStateInPandas(statefulProcessor=Route(key, time, ellps, forget), outputStructType=schema, outputMode="append", timeMode="eventTime")
