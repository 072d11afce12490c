"""A store of grids as a table of cells, for lookups as joins.

Each cell of a grid is a row with its corner values, so a lookup is an equality join on grid, part, row and column. The
store is a Parquet table of cells partitioned by grid, with a small table of heads in `_heads` beside them. Cells are
written before heads, and taken out after them: what heads tell is there whole. Files go into the store through
executors (see sources.griddata); a grid in memory, which is small, from the driver.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import griddata
from .griddata import CELLS, HEADS
from .gridfiles import Grid, Head


def flattened(grid: Grid) -> list[Head]:
    """A grid in memory as heads."""
    out: list[Head] = []

    def put(g: Grid, parent: int) -> None:
        if not g.hollow:
            out.append(Head(g.name, g.north, g.west, g.dlat, g.dlon, g.rows, g.columns, g.bands, g.kind, g.projected, lambda a, b: g.nodes[a:b], parent))
        at = -1 if g.hollow else len(out) - 1
        for part in g.parts:
            put(part, at)

    put(grid, -1)
    return out


def cells(spark: SparkSession, grid: Grid) -> DataFrame:
    """The cells of a grid in memory and its parts; parts have higher levels."""
    found = griddata.placed(flattened(grid))
    batches = [b for part, level, h in found for b in griddata.cell_batches(grid.name, part, level, h, 0, h.rows - 1)]
    # from arrays: the driver holds the grid as it was read, but no row of Python objects for each cell
    return spark.createDataFrame(pa.Table.from_batches(batches)).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in CELLS.split(", ")])


def heads(spark: SparkSession, grid: Grid) -> DataFrame:
    return spark.createDataFrame(list(griddata.head_rows(grid.name, flattened(grid))), HEADS)


def _put(cell: DataFrame, head: DataFrame, store: str) -> None:
    cell.write.mode("append").partitionBy("grid_id").parquet(store)
    head.write.mode("append").parquet(f"{store.rstrip('/')}/_heads")


def add(spark: SparkSession, grid: Grid, store: str) -> None:
    """A grid in memory into the store, in place of one of its name."""
    remove(spark, grid.name, store)
    _put(cells(spark, grid), heads(spark, grid), store)


def add_file(spark: SparkSession, path: str, store: str, name: str | None = None) -> None:
    """A grid file of any size into the store, through executors."""
    named = name or path.rsplit("/", 1)[-1]
    remove(spark, named, store)
    _put(griddata.rows_of(spark, path, named), griddata.rows_of(spark, path, named, "heads"), store)


def table(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(store)


def known(spark: SparkSession, store: str) -> DataFrame:
    """The heads of a store."""
    return spark.read.schema(HEADS).parquet(f"{store.rstrip('/')}/_heads")


def paths(spark: SparkSession, store: str) -> DataFrame:
    """(grid_id, path, bytes) of the store's files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(store).select("grid_id", "path", F.col("length").alias("bytes"))


def names(spark: SparkSession, store: str) -> DataFrame:
    return table(spark, store).groupBy("grid_id").agg(F.max("level").alias("level"), F.count("*").alias("cells"))


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _partitions(spark: SparkSession, folder: str) -> dict[str, str]:
    """Paths of the partitions in a folder, by grid."""
    p, fs = _folder(spark, folder)
    found = [str(s.getPath().toString()) for s in fs.listStatus(p)] if fs.exists(p) else []
    return {unquote(f.rsplit("grid_id=", 1)[1]): f for f in found if "/grid_id=" in f}


def _of(grid_id: str, wanted: str) -> bool:
    return grid_id == wanted or grid_id.startswith(f"{wanted}/") and grid_id[len(wanted) + 1 :].isdigit()


def _swap(spark: SparkSession, fresh: str, folder: str) -> None:
    """Puts a written folder in the place of another; what was there goes last. `recover` ends a swap that broke off."""
    (new, fs), (old, _) = _folder(spark, fresh), _folder(spark, folder)
    parent, name = folder.rsplit("/", 1)
    gone, _ = _folder(spark, f"{parent}/_gone-{name.replace('=', '~', 1)}")  # a name that readers don't see
    if fs.exists(old) and not fs.rename(old, gone):
        raise OSError(f"{folder} can't be moved")
    if not fs.rename(new, old):
        fs.rename(gone, old)
        raise OSError(f"{fresh} can't be moved")
    fs.delete(gone, True)


def recover(spark: SparkSession, store: str) -> None:
    """Ends what a lost driver left half done: a folder that was moved away comes back if nothing took its place."""
    p, fs = _folder(spark, store)
    for s in fs.listStatus(p) if fs.exists(p) else []:
        parent, name = str(s.getPath().toString()).rsplit("/", 1)
        if name.startswith("_gone-"):
            back, _ = _folder(spark, f"{parent}/{name.removeprefix('_gone-').replace('grid_id~', 'grid_id=', 1)}")
            if fs.exists(back):
                fs.delete(s.getPath(), True)
            else:
                fs.rename(s.getPath(), back)
    fresh, fs = _folder(spark, f"{store.rstrip('/')}/_vacuum")
    if fs.exists(fresh):
        fs.delete(fresh, True)


def remove(spark: SparkSession, grid_id: str, store: str) -> bool:
    """Takes a grid out of the store; False if it isn't there."""
    root = store.rstrip("/")
    p, fs = _folder(spark, f"{root}/_heads")
    found = {g: path for g, path in _partitions(spark, root).items() if _of(g, grid_id)}
    if fs.exists(p):
        other = known(spark, store).filter(~F.col("grid_id").isin(grid_id, *found))
        if known(spark, store).count() != other.count():
            fresh = f"{root}/_heads-{uuid.uuid4().hex}"
            other.coalesce(1).write.parquet(fresh)
            _swap(spark, fresh, f"{root}/_heads")
    for path in found.values():
        fs.delete(_folder(spark, path)[0], True)
    return bool(found)


def vacuum(spark: SparkSession, store: str, files: int = 1) -> None:
    """Rewrites each grid's cells in `files` files, in order of rows and columns. The new files are whole before they
    take the old ones' place, a grid at a time."""
    root = store.rstrip("/")
    recover(spark, store)
    table(spark, store).repartition("grid_id", F.pmod(F.col("row"), F.lit(files))).sortWithinPartitions("part", "row", "col").write.partitionBy("grid_id").parquet(f"{root}/_vacuum")
    old = _partitions(spark, root)
    for grid, path in _partitions(spark, f"{root}/_vacuum").items():
        _swap(spark, path, old[grid])
    p, fs = _folder(spark, f"{root}/_vacuum")
    fs.delete(p, True)


def place(c: Column, origin: Column, step: Column, count: Column) -> Column:
    """The cell along one axis, border cells reaching outwards."""
    return F.least(F.greatest(F.floor((c - origin) / step), F.lit(0)), count - 2).cast("int")


def lookup(points: DataFrame, table: DataFrame, lon: str, lat: str, bands: int, name: str = "v", order: tuple[str, ...] = ()) -> DataFrame:
    """Points (radians) within any grid of the table, with bilinear values v1, v2, ...; points outside all are left
    out. Of several grids around a point, those named in `order` (grid ids) go first, then the highest level, then the
    smallest id; parts don't own their north and east borders. The cells are joined by grid, extent, row and column."""
    x, y = F.col(lon), F.col(lat)
    rank = F.coalesce(*[F.when(F.col("grid_id") == g, F.lit(k)) for k, g in enumerate(order)], F.lit(len(order)))
    # the extents are one row, with an item for each grid
    heads = table.select(F.struct(rank.alias("rank"), (-F.col("level")).alias("over"), "grid_id", "north", "west", "dlat", "dlon", "rows", "cols").alias("g")).distinct().agg(F.collect_list("g").alias("__grids"))

    def around(g: Column) -> Column:
        border = F.when(g["over"] < 0, F.lit(-1e-12)).otherwise(F.lit(1e-12))
        east, south = g["west"] + (g["cols"] - 1) * g["dlon"], g["north"] - (g["rows"] - 1) * g["dlat"]
        return (x >= g["west"] - 1e-12) & (x <= east + border) & (y <= g["north"] + border) & (y >= south - 1e-12)

    placed = points.crossJoin(F.broadcast(heads)).withColumn("__grid", F.array_min(F.filter("__grids", around))).filter("__grid is not null").select(*points.columns, "__grid.*")
    placed = placed.withColumn("row", place(-y, -F.col("north"), F.col("dlat"), F.col("rows"))).withColumn("col", place(x, F.col("west"), F.col("dlon"), F.col("cols")))
    same = ["grid_id", "north", "west", "dlat", "dlon", "row", "col"]  # parts may share a name
    found = placed.join(table.select(*same, "nw", "ne", "sw", "se"), same)
    u = (x - F.col("west")) / F.col("dlon") - F.col("col")
    v = (F.col("north") - y) / F.col("dlat") - F.col("row")
    value = lambda k: (1 - v) * ((1 - u) * F.col("nw")[k] + u * F.col("ne")[k]) + v * ((1 - u) * F.col("sw")[k] + u * F.col("se")[k])
    return found.select(*points.columns, *[value(k).alias(f"{name}{k + 1}") for k in range(bands)])


def as_grid(values: np.ndarray, north: float, west: float, step: float, name: str = "grid", kind: str = "horizontal") -> Grid:
    """A grid from an array of nodes, north first; degrees."""
    r = np.pi / 180
    return Grid(name, north * r, west * r, step * r, step * r, values, kind)
