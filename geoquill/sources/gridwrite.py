"""Writes small grids as files: NTv2, GTX, Gravsoft, Golden Software ASCII and GeoTIFF."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
from pyspark.sql import SparkSession

from .gridfiles import Grid

DEGREE = 180 / math.pi


def ntv2(grid: Grid) -> bytes:
    """Two bands; parts become sub-grids."""
    record = lambda key, value: key.ljust(8).encode() + value.ljust(8, b"\0")
    whole = lambda v: struct.pack("<i", v)
    grids = [(grid, "NONE"), *((p, "G0") for p in grid.parts)]
    out = [record("NUM_OREC", whole(11)), record("NUM_SREC", whole(11)), record("NUM_FILE", whole(len(grids)))]
    out += [record(k, b"SECONDS " if k == "GS_TYPE" else b"") for k in ("GS_TYPE", "VERSION", "SYSTEM_F", "SYSTEM_T", "MAJOR_F", "MINOR_F", "MAJOR_T", "MINOR_T")]
    for k, (g, parent) in enumerate(grids):
        angles = (("S_LAT", g.south), ("N_LAT", g.north), ("E_LONG", -g.east), ("W_LONG", -g.west), ("LAT_INC", g.dlat), ("LONG_INC", g.dlon))
        out += [record("SUB_NAME", f"G{k}".ljust(8).encode()), record("PARENT", parent.ljust(8).encode()), record("CREATED", b""), record("UPDATED", b"")]
        out += [record(n, struct.pack("<d", v * DEGREE * 3600)) for n, v in angles] + [record("GS_COUNT", whole(g.rows * g.columns))]
        nodes = np.zeros((g.rows, g.columns, 4), "<f4")
        nodes[..., 0], nodes[..., 1] = g.nodes[..., 1], -g.nodes[..., 0]  # latitude first, longitude positive to the west
        out.append(nodes[::-1, ::-1].tobytes())
    return b"".join([*out, record("END", b"")])


def gtx(grid: Grid) -> bytes:
    head = struct.pack(">4d2i", grid.south * DEGREE, grid.west * DEGREE, grid.dlat * DEGREE, grid.dlon * DEGREE, grid.rows, grid.columns)
    return head + np.where(np.isnan(grid.nodes), np.float32(-88.8888), grid.nodes)[::-1].astype(">f4").tobytes()


def gravsoft(grid: Grid) -> bytes:
    extent = " ".join(repr(v * DEGREE) for v in (grid.south, grid.north, grid.west, grid.east, grid.dlat, grid.dlon))
    nodes = grid.nodes[..., ::-1] if grid.bands == 2 else grid.nodes
    rows = [" ".join(repr(float(v)) for v in np.where(np.isnan(r), 9999, r).ravel()) for r in nodes]
    return "\n".join([extent, *rows, ""]).encode()


def gsa(grid: Grid) -> bytes:
    blocks = []
    for band in range(grid.bands):
        v = grid.nodes[::-1, :, band]
        blocks.append(f"DSAA\n{grid.columns} {grid.rows}\n{grid.west * DEGREE!r} {grid.east * DEGREE!r}\n{grid.south * DEGREE!r} {grid.north * DEGREE!r}\n{v.min()} {v.max()}\n" + "\n".join(" ".join(repr(float(x)) for x in r) for r in v))
    return "\n".join(blocks).encode()


def geotiff(grid: Grid, tile: int = 16) -> bytes:
    """Deflated tiles of single floats; horizontal offsets, or heights."""
    from .geotiff import TAGS

    names = ("longitude_offset", "latitude_offset") if grid.bands == 2 else ("geoid_undulation",)
    kind = "HORIZONTAL_OFFSET" if grid.bands == 2 else "VERTICAL_OFFSET_GEOGRAPHIC_TO_VERTICAL"
    body, places, sizes = bytearray(8), [], []
    padded = np.pad(grid.nodes, ((0, -grid.rows % tile), (0, -grid.columns % tile), (0, 0)))
    for top in range(0, grid.rows, tile):
        for left in range(0, grid.columns, tile):
            raw = zlib.compress(padded[top : top + tile, left : left + tile].astype("<f4").tobytes())
            places.append(len(body))
            sizes.append(len(raw))
            body += raw + b"\0" * (len(raw) % 2)
    items = f'<Item name="TYPE">{kind}</Item>' + "".join(f'<Item name="DESCRIPTION" sample="{k}" role="description">{n}</Item>' for k, n in enumerate(names))
    fields = {
        "width": ("I", [grid.columns]), "height": ("I", [grid.rows]), "bits": ("H", [32] * grid.bands), "compression": ("H", [8]), "samples": ("H", [grid.bands]), "planar": ("H", [1]), "predictor": ("H", [1]),
        "format": ("H", [3] * grid.bands), "tile_width": ("I", [tile]), "tile_height": ("I", [tile]), "tiles": ("I", places), "tile_sizes": ("I", sizes), "scale": ("d", [grid.dlon * DEGREE, grid.dlat * DEGREE, 0.0]),
        "tie": ("d", [0.0, 0.0, 0.0, grid.west * DEGREE, grid.north * DEGREE, 0.0]), "keys": ("H", [1, 1, 0, 1, 1025, 0, 1, 2]), "metadata": ("s", f"<GDALMetadata>{items}</GDALMetadata>\0".encode()),
    }
    codes, entries = {"s": 2, "H": 3, "I": 4, "d": 12}, []
    for name, (code, v) in sorted(fields.items(), key=lambda f: TAGS[f[0]]):
        raw = v if code == "s" else struct.pack(f"<{len(v)}{code}", *v)
        held = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", len(body))
        if len(raw) > 4:
            body += raw + b"\0" * (len(raw) % 2)
        entries.append(struct.pack("<HHI", TAGS[name], codes[code], len(v)) + held)
    body[:8] = b"II" + struct.pack("<HI", 42, len(body))
    return bytes(body + struct.pack("<H", len(entries)) + b"".join(entries) + b"\0" * 4)


WRITERS = {"gsb": ntv2, "gtx": gtx, "gri": gravsoft, "gsa": gsa, "tif": geotiff}


def write(spark: SparkSession, grid: Grid, path: str) -> str:
    """The grid as a file, by the path's ending, in any store that Spark writes to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(WRITERS[path.rsplit(".", 1)[-1]](grid))
    finally:
        out.close()
    return path
