"""As-of joins: each row with the latest row of another table at or before its time, and transformations whose
parameters hold from such a time on.

Both sides are merged into one table in order of time, and a window carries the last known row of the other side on;
nothing is compared pairwise. Time is cut into slices of about equal numbers of rows, so the rows of a busy key (or of
all rows, where there is no key) are dealt over many tasks. What a slice must know of the time before it is found from
one row for each key and slice, and is put in at the slice's beginning.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import E, Sql, wrap
from ..operators.transforms import similarity

#: Slices of one join at most; beyond, they get larger.
SLICES = 10_000


def _seconds(c: Column, kind: str) -> Column:
    """A time, date or number in order, as a double."""
    return F.unix_micros(c.cast("timestamp")).cast("double") if kind in ("timestamp", "timestamp_ntz", "date") else c.cast("double")


def as_of(left: DataFrame, right: DataFrame, on: str, right_on: str | None = None, by: list[str] | None = None, into: str = "found", rows: int = 1_000_000) -> DataFrame:
    """All rows and columns of `left`, and in `into` a struct of the row of `right` with equal `by` columns and the
    latest `right_on` that isn't after `on`: null where there is none. Of several at one time the greatest by the other
    columns, in their order. Rows of a null or NaN time, or of a null key, find nothing and are found by nothing.
    `rows`: of a slice."""
    by, at = list(by or []), right_on or on
    keys = [f"_k{i}" for i in range(len(by))]
    whole = F.struct(*[F.col(f"`{c}`") for c in right.columns])
    time = lambda df, c: _seconds(F.col(f"`{c}`"), df.schema[c].dataType.typeName())
    key = lambda c, k: F.col(f"`{c}`").alias(k)
    a = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"), *map(key, by, keys), time(left, on).alias("_at"))
    usable = ~F.isnan("_at") & F.col("_at").isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    b = right.select(whole.alias("_new"), *map(key, by, keys), time(right, at).alias("_at")).filter(usable)
    good = F.coalesce(usable, F.lit(False))
    asks, rest = a.filter(good), a.filter(~good)
    count = max(1, min(SLICES, -(-asks.count() // rows)))
    cuts = sorted(set(asks.agg(F.percentile_approx("_at", [k / count for k in range(1, count)], 10 * count)).first()[0] or [])) if count > 1 else []
    if cuts:
        slicer = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_at", outputCol="_slice", handleInvalid="keep")
        asks, b = slicer.transform(asks), slicer.transform(b)
    else:
        asks, b = asks.withColumn("_slice", F.lit(0.0)), b.withColumn("_slice", F.lit(0.0))
    # what each slice brings, and what it must know of those before
    order = F.struct("_at", "_new")
    marks = b.groupBy(*keys, "_slice").agg(F.max(order)["_new"].alias("_new")).unionByName(asks.select(*keys, "_slice").distinct().withColumn("_new", F.lit(None).cast(b.schema["_new"].dataType)))
    marks = marks.groupBy(*keys, "_slice").agg(F.max("_new").alias("_new"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    known = marks.select(*keys, "_slice", F.last("_new", ignorenulls=True).over(before).alias("_new")).filter("_new is not null") if cuts else None
    empty = F.lit(None).cast(asks.schema["_row"].dataType)
    line = asks.select(*keys, "_slice", "_at", F.lit(1).alias("_turn"), "_row", F.lit(None).cast(b.schema["_new"].dataType).alias("_new"))
    line = line.unionByName(b.select(*keys, "_slice", "_at", F.lit(0).alias("_turn"), empty.alias("_row"), "_new"))
    if known is not None:
        line = line.unionByName(known.select(*keys, "_slice", F.lit(-math.inf).alias("_at"), F.lit(-1).alias("_turn"), empty.alias("_row"), "_new"))
    merged = Window.partitionBy(*keys, "_slice").orderBy("_at", "_turn", "_new").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = line.select("_turn", "_row", F.last("_new", ignorenulls=True).over(merged).alias(into)).filter("_turn = 1")
    out = found.select("_row", into).unionByName(rest.select("_row", F.lit(None).cast(b.schema["_new"].dataType).alias(into)))
    return out.select("_row.*", into)


#: Columns of a parameter set, as the helmert operator names them; those that aren't there are 0.
SET = ("x", "y", "z", "dx", "dy", "dz", "rx", "ry", "rz", "drx", "dry", "drz", "s", "ds", "t_epoch")


def helmert_at(points: DataFrame, sets: DataFrame, on: str, right_on: str | None = None, by: list[str] | None = None, xyz: tuple[str, str, str] = ("x", "y", "z"), t: str | None = None, direction: str = "fwd", exact: bool = False, convention: str = "coordinate_frame", into: tuple[str, str, str] = ("x", "y", "z"), ok: str = "ok", rows: int = 1_000_000) -> DataFrame:
    """Geocentric coordinates transformed by the parameter set that is valid at each row's time `on`: metres, seconds of
    arc, parts per million, and their rates a year from the set's t_epoch, where `t` names the epoch in years. All
    columns of `points`, the result and `ok`; rows before the first set fail and are NaN."""
    found = as_of(points, sets, on, right_on, by, "_set", rows)
    have = {c for c in SET if c in sets.columns}
    if have & {"dx", "dy", "dz", "drx", "dry", "drz", "ds"} and not ("t_epoch" in have and t):
        raise ValueError("rates need the sets' t_epoch, and t of the points")
    number = lambda c: f"coalesce(double({c}), double('NaN'))"
    start = found.selectExpr("*", *[f"{number(f'`{c}`')} AS _p{k}" for k, c in enumerate(xyz)], f"{number(f'`{t}`') if t else number('null')} AS _p3", *[f"{number(f'_set.`{c}`')} AS _v_{c}" for c in have])
    m = Sql("_h")
    value = lambda c, unit=1.0: E(f"_v_{c}") * unit if c in have else 0.0
    turn = math.radians(1 / 3600)
    op = similarity([value(c) for c in "xyz"], [value(c) for c in ("dx", "dy", "dz")], [value(c, turn) for c in ("rx", "ry", "rz")], [value(c, turn) for c in ("drx", "dry", "drz")], value("s"), value("ds"), value("t_epoch"), exact, convention == "position_vector")
    made = (op.fwd if direction == "fwd" else op.inv)(m, *[E(f"_p{k}") for k in range(4)])
    values = [wrap(v) for v in m.let(*made[:3])]
    start = m.named(start)
    good = " AND ".join(f"NOT isnan({v.s})" for v in values) + " AND _set IS NOT NULL"
    kept = [f"`{c}`" for c in points.columns if c not in {*into, ok}]
    return start.selectExpr(*kept, *[f"if({good}, {v.s}, double('NaN')) AS `{n}`" for v, n in zip(values, into, strict=True)], f"{good} AS `{ok}`")
