"""Where segments of the plane meet: a join of two tables of segments, or of one with itself.

Segments are walked through square tiles about as wide as they are long on average, and meet within tiles. Tiles with many segments are split: the parts within are walked again through finer tiles, finer the more there
are. Each common point is computed from the whole segments and reported by the one tile that it lies in, so no pair
counts twice and nothing is put together afterwards. There is no comparison beyond a tile, and none of all pairs.

The tables are few bytes for the work that comes of them, so walks and tiles are dealt out to tasks by numbers of
segments and of pairs; the pairs of a task are compared on arrays, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import scratch

ENDS = ("x1", "y1", "x2", "y2")
#: An overfull tile is halved so often at most (segments through one point can't be told apart by tiles).
HALVINGS = 10
#: Segments of a task that walks them, and pairs of one that compares them.
WALKED, PAIRS = 100_000, 16_000_000
#: Pairs that are compared at once.
BLOCK = 100_000


def _range(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low), F.floor(high)))


def _walk(df: DataFrame, size: Column, pad: float, names: tuple[str, str], within: tuple[Column, Column] | None = None) -> DataFrame:
    """df with a row for each tile that a segment comes within `pad` of, of those `within` (a range of each axis) only."""
    x1, y1, x2, y2 = (F.col(c) for c in ENDS)
    low, high = F.least(y1, y2) - pad, F.greatest(y1, y2) + pad
    if within:
        low, high = F.greatest(low, within[1][0]), F.least(high, within[1][1])
    rows = df.filter(low <= high).withColumn(names[1], _range(low / size, high / size))
    bottom, top = F.col(names[1]) * size - pad, (F.col(names[1]) + 1) * size + pad
    level = y1 == y2
    u, v = F.when(~level, (bottom - y1) / (y2 - y1)), F.when(~level, (top - y1) / (y2 - y1))
    first, last = F.when(level, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(u, v))), F.when(level, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(u, v)))
    a, b = x1 + F.least(F.lit(1.0), first) * (x2 - x1), x1 + F.greatest(F.lit(0.0), last) * (x2 - x1)
    left, right = F.least(a, b) - pad, F.greatest(a, b) + pad
    if within:
        left, right = F.greatest(left, within[0][0]), F.least(right, within[0][1])
    rows = rows.withColumns({"_left": left, "_right": right}).filter("_left <= _right")
    return rows.withColumn(names[0], _range(F.col("_left") / size, F.col("_right") / size)).drop("_left", "_right")


def _pairs(tiles: np.ndarray, side: np.ndarray, runs: np.ndarray, one: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i and j of each tile, in turns of about BLOCK pairs: each pair of different keys once where there is `one` table,
    else of side 1 with side 2. Rows are in order of tile, side and key; runs number the keys."""
    rows = np.arange(len(tiles))
    ends = np.searchsorted(tiles, tiles, "right")
    # the first partner: of another key, or of the other side
    first = np.searchsorted(runs, runs, "right") if one else np.searchsorted(tiles * 2 + (side == 2), tiles * 2 + 1)
    n = np.where((side == 1), np.maximum(ends - first, 0), 0)
    total = np.concatenate(([0], np.cumsum(n)))
    at = 0
    while at < len(rows):
        upto = max(at + 1, int(np.searchsorted(total, total[at] + BLOCK, "right")) - 1)
        m = n[at:upto]
        i = np.repeat(rows[at:upto], m)
        yield i, np.arange(total[at], total[upto]) - np.repeat(total[at:upto] - first[at:upto], m)
        at = upto


def _common(p: list[np.ndarray], near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of segments on one line: pair, x and y of the ends that lie within the other segment, each place once, as
    `columns.intersection` has them."""
    a, b, c, d = p[0:2], p[2:4], p[4:6], p[6:8]
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q, o, e in ((c, a, b), (d, a, b), (a, c, d), (b, c, d)):
        there = np.logical_and.reduce([(q[k] >= np.minimum(o[k], e[k]) - near) & (q[k] <= np.maximum(o[k], e[k]) + near) for k in (0, 1)])
        for was, x, y in kept:
            there &= ~was | (np.abs(q[0] - x) >= near) | (np.abs(q[1] - y) >= near)
        kept.append((there, q[0], q[1]))
    rows = [np.flatnonzero(t) for t, _, _ in kept]
    return np.concatenate(rows), np.concatenate([x[r] for r, (_, x, _) in zip(rows, kept, strict=True)]), np.concatenate([y[r] for r, (_, _, y) in zip(rows, kept, strict=True)])


def _tile(rows: pa.Table, size: float, near: float, one: bool) -> Iterator[pa.RecordBatch]:
    """Common points of the segments of some whole tiles."""
    key = {n: rows[n].to_numpy() for n in ("tx", "ty", "px", "py", "fine")}
    new = np.concatenate(([False], np.logical_or.reduce([v[1:] != v[:-1] for v in key.values()])))
    tiles, side, ids = np.cumsum(new), rows["side"].to_numpy(), rows["id"].combine_chunks()
    runs = np.cumsum(new | np.concatenate(([False], pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False))))
    ends = [rows[n].to_numpy() for n in ENDS]
    width = size / np.exp2(key["fine"])
    for i, j in _pairs(tiles, side, runs, one):
        p = [*(v[i] for v in ends), *(v[j] for v in ends)]
        x1, y1, x2, y2, x1b, y1b, x2b, y2b = p
        ux, uy, vx, vy, wx, wy = x2 - x1, y2 - y1, x2b - x1b, y2b - y1b, x1b - x1, y1b - y1
        bend, along_a, along_b = ux * vy - uy * vx, wx * vy - wy * vx, wx * uy - wy * ux
        # crosses of all four ends are small only where segments are on one line, or points
        line = (np.abs(along_b) < near) & (np.abs(along_a) < near)
        line[line] &= ((np.abs(ux * (wy + vy) - uy * (wx + vx)) < near) & (np.abs(vx * (wy - uy) - vy * (wx - ux)) < near))[line]
        t, s = along_a / bend, along_b / bend
        slack, slack2 = near / np.maximum(np.abs(ux), np.abs(uy)), near / np.maximum(np.abs(vx), np.abs(vy))
        met = np.flatnonzero((bend != 0) & (t >= -slack) & (t <= 1 + slack) & (s >= -slack2) & (s <= 1 + slack2) & ~line)
        x, y = x1[met] + t[met] * ux[met], y1[met] + t[met] * uy[met]
        lined = np.flatnonzero(line)
        if len(lined):
            which, more_x, more_y = _common([v[lined] for v in p], near)
            met, x, y = np.concatenate((met, lined[which])), np.concatenate((x, more_x)), np.concatenate((y, more_y))
        i, j = i[met], j[met]
        # the tile of the point, coarse and fine, as the walk numbers them
        here = np.logical_and.reduce([np.floor(v / w) == key[n][i] for v, w, n in ((x, size, "tx"), (y, size, "ty"), (x, width[i], "px"), (y, width[i], "py"))])
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(i[here])), ids.take(pa.array(j[here])), pa.array(x[here]), pa.array(y[here])], ["id1", "id2", "x", "y"])


def _met(batches: Iterator[pa.RecordBatch], size: float, near: float, one: bool) -> Iterator[pa.RecordBatch]:
    """Common points from rows in order of tile, side and key; the last tile of what was read waits for its end."""
    held: list[pa.RecordBatch] = []
    names = ("tx", "ty", "px", "py", "fine")
    last = None
    with np.errstate(all="ignore"):
        for batch in batches:
            if not len(batch):
                continue
            tail = tuple(batch[n][len(batch) - 1].as_py() for n in names)
            begins = int(np.flatnonzero(~np.logical_and.reduce([batch[n].to_numpy() == v for n, v in zip(names, tail, strict=True)]))[-1:].sum() + 1)
            begins = 0 if tuple(batch[n][0].as_py() for n in names) == tail else begins
            if held and (begins or last != tail):
                yield from _tile(pa.Table.from_batches([*held, batch[:begins]]), size, near, one)
                held = []
            elif begins:
                yield from _tile(pa.Table.from_batches([batch[:begins]]), size, near, one)
            held.append(batch[begins:])
            last = tail
        if held:
            yield from _tile(pa.Table.from_batches(held), size, near, one)


def crossings(a: DataFrame, b: DataFrame | None = None, key: str = "id", near: float = 1e-9, full: int = 256) -> DataFrame:
    """(id1, id2, x, y): the common points of segments of a and b, each with the columns `key`, x1, y1, x2, y2: one for
    each crossing or touching, the two ends where segments lie on one line and overlap. Without b, those of a with each
    other, each pair once (by smaller key first; rows of one key don't meet). Segments may be points. Rows with a null
    key, or an end that is null, NaN or infinite, meet nothing. `full`: segments of a tile before it is split."""
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    usable = " and ".join(f"abs({c}) < double('Infinity')" for c in ENDS)
    prepare = lambda df, side: df.select(F.col(f"`{key}`").alias("id"), *[number(c).alias(c) for c in ENDS], F.lit(side).alias("side")).filter(f"id is not null and {usable}")
    rows = prepare(a, 1) if b is None else prepare(a, 1).unionByName(prepare(b, 2))
    across, along = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    reach = lambda c: F.greatest(F.abs(F.col(f"{c}1")), F.abs(F.col(f"{c}2")))
    shape = rows.agg(F.avg(F.greatest(across, along)).alias("mean"), F.max(F.greatest(reach("x"), reach("y"))).alias("far"), F.count("*").alias("n")).first()
    far = shape["far"] or 1.0
    # no finer than the plane's extent can be told apart, however short the segments are
    size = max(shape["mean"] or 0.0, far * 2.0**-30, 1e-300)
    pad = max(2 * near, far * 1e-12)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    # files of few bytes hold many segments: tasks by the work that comes of them
    tiled = _walk(rows.repartition(max(cores, shape["n"] // WALKED), "id"), F.lit(size), pad, ("tx", "ty"))
    counts = tiled.groupBy("tx", "ty").agg(F.count("*").alias("n")).filter(F.col("n") > full)
    halvings = F.least(F.lit(HALVINGS), F.ceil(F.log2(F.col("n") / full))).cast("int")
    tiled = tiled.join(counts.select("tx", "ty", halvings.alias("fine")), ["tx", "ty"], "left").withColumn("fine", F.coalesce("fine", F.lit(0)))
    width = F.lit(size) / F.pow(F.lit(2.0), F.col("fine"))
    span = lambda c: (F.col(c) * size - pad, (F.col(c) + 1) * size + pad)
    # read several times, and far shorter to plan with than the walks
    parts = scratch.kept(_walk(tiled, width, pad, ("px", "py"), (span("tx"), span("ty"))), "tiles")
    tile = ["tx", "ty", "px", "py", "fine"]
    work = parts.groupBy(*tile).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("pairs"), F.sum("n").alias("n")).first()
    tasks = max(cores, (work["pairs"] or 0) // PAIRS, (work["n"] or 0) // WALKED)
    # a table of tiles is few bytes and much work, so nothing is broadcast
    parts = parts.repartition(tasks, *tile).sortWithinPartitions(*tile, "side", "id")
    kind = dict(parts.dtypes)["id"]
    return parts.mapInArrow(partial(_met, size=size, near=near, one=b is None), f"id1 {kind}, id2 {kind}, x double, y double")
