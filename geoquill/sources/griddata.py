"""Grid files as a data source: `spark.read.format("geoquill_grid").load(path)`.

A partition is a band of rows of one grid of the file. The driver reads no more than the heads; each task reads its
band by byte range (a map of the file, or a range request) and gives the band's cells in Arrow batches. Tiled and
striped GeoTIFF files are decoded by the tiles that a band meets, text formats whole by the task that needs them.

Options: `path`, `name` (of the grid; the file's name by default), `cells` (of a partition, a million by default), and
`what`: `cells` (default) or `heads`, a row for each grid of the file. Paths are local ones, `file:`, or of a file
system that pyarrow opens; `rows_of` takes files of other stores whole, through Spark, in a task for each.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .gridfiles import Head, heads, ordered

FORMAT = "geoquill_grid"
HEADS = "grid_id string, part int, level int, top boolean, kind string, projected boolean, bands int, north double, west double, dlat double, dlon double, rows int, cols int"
CELLS = "grid_id string, part int, level int, north double, west double, dlat double, dlon double, rows int, cols int, row int, col int, nw array<double>, ne array<double>, sw array<double>, se array<double>"
#: Cells of a batch.
BATCH = 20_000


class Ranged:
    """A file of a remote store, sliced like bytes."""

    def __init__(self, file):
        self.file, self.size = file, file.size()

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, place: slice) -> bytes:
        start, stop, _ = place.indices(self.size)
        return self.file.read_at(max(0, stop - start), start)


def local(path: str) -> str | None:
    """The path on this machine, of local paths and file: URIs."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" not in path else None


def ranged(path: str) -> bool:
    """Whether the source itself can open the path."""
    if local(path) is not None:
        return True
    import pyarrow.fs  # starts threads, so only where it is needed

    try:
        pyarrow.fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, OSError):
        return False
    return True


def opened(path: str):
    here = local(path)
    if here is not None:
        with open(here, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    import pyarrow.fs

    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    return Ranged(fs.open_input_file(inner))


def placed(found: list[Head]) -> list[tuple[int, int, Head]]:
    """(part, level, head): parts in order of precedence."""
    depth = lambda k: 0 if found[k].parent < 0 else 1 + depth(found[k].parent)
    return [(part, depth(k), found[k]) for part, k in enumerate(ordered(found))]


def label(name: str, level: int) -> str:
    return f"{name}/{level}" if level else name


def head_rows(name: str, found: list[Head]) -> Iterator[tuple]:
    kinds = {h.bands for h in found if h.parent < 0}
    if len(kinds) > 1:
        raise ValueError(f"{name}: grids of several kinds side by side are read into memory only")
    for part, level, h in placed(found):
        yield label(name, level), part, level, h.parent < 0, h.kind, h.projected, h.bands, h.north, h.west, h.dlat, h.dlon, h.rows, h.columns


def cell_batches(name: str, part: int, level: int, h: Head, first: int, last: int) -> Iterator[pa.RecordBatch]:
    """Cells of the rows from first to last, from nodes that are read a few rows at a time."""
    step = max(1, BATCH // max(1, h.columns - 1))
    for top in range(first, last, step):
        bottom = min(last, top + step)
        n = np.asarray(h.nodes(top, bottom + 1), np.float32).astype(float)
        i, j = (x.ravel() for x in np.mgrid[: bottom - top, : h.columns - 1])
        corner = lambda down, right: pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1, dtype=np.int32) * h.bands), pa.array(n[i + down, j + right].ravel()))  # noqa: B023, E731
        same = lambda x, kind: pa.repeat(pa.scalar(x, kind), len(i))  # noqa: B023, E731
        columns = [same(label(name, level), pa.string()), same(part, pa.int32()), same(level, pa.int32()), *(same(float(x), pa.float64()) for x in (h.north, h.west, h.dlat, h.dlon)), *(same(x, pa.int32()) for x in (h.rows, h.columns))]
        columns += [pa.array((i + top).astype(np.int32)), pa.array(j.astype(np.int32)), *(corner(*x) for x in ((0, 0), (0, 1), (1, 0), (1, 1)))]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in CELLS.split(", ")])


@dataclass
class Band(InputPartition):
    part: int
    first: int
    last: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.name = options.get("name") or self.path.rsplit("/", 1)[-1]
        self.file, self.what, self.cells = self.path.rsplit("/", 1)[-1], options.get("what", "cells"), int(options.get("cells", 1_000_000))

    def partitions(self) -> list[InputPartition]:
        if self.what == "heads":
            return [Band(-1, 0, 0)]
        out: list[InputPartition] = []
        for part, _, h in placed(heads(self.file, opened(self.path))):
            step = max(1, self.cells // max(1, h.columns - 1))
            out += [Band(part, top, min(h.rows - 1, top + step)) for top in range(0, h.rows - 1, step)]
        return out

    def read(self, band: Band) -> Iterator:
        found = heads(self.file, opened(self.path))
        if self.what == "heads":
            yield from head_rows(self.name, found)
            return
        part, level, h = next(x for x in placed(found) if x[0] == band.part)
        yield from cell_batches(self.name, part, level, h, band.first, band.last)


class GridSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return HEADS if self.options.get("what", "cells") == "heads" else CELLS

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)


def rows_of(spark: SparkSession, path: str, name: str | None = None, what: str = "cells") -> DataFrame:
    """Cells or heads of a grid file."""
    named = name or path.rsplit("/", 1)[-1]
    if ranged(path):
        spark.dataSource.register(GridSource)
        return spark.read.format(FORMAT).option("name", named).option("what", what).load(path)
    file = path.rsplit("/", 1)[-1]
    schema = to_arrow_schema(StructType.fromDDL(HEADS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found = heads(file, content.as_py())
                if what == "heads":
                    names = [c.split()[0] for c in HEADS.split(", ")]
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in head_rows(named, found)], schema)
                    continue
                for part, level, h in placed(found):
                    yield from cell_batches(named, part, level, h, 0, h.rows - 1)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, CELLS if what == "cells" else HEADS)
