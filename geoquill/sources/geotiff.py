"""Grids in GeoTIFF files: floating-point rasters in strips or tiles, without compression, by LZW or by deflate, with
the metadata that tells which sample is which offset. Several images become parts of one grid. Of the data only the
places that are needed are sliced, so a file may be mapped or read by range."""

from __future__ import annotations

import math
import struct
import zlib
from dataclasses import replace
from xml.etree import ElementTree

import numpy as np

from .gridfiles import Grid, Head, whole

#: Bytes and codes of the field types; tags by name.
KINDS = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 7: (1, "s"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
TAGS = {
    "width": 256, "height": 257, "bits": 258, "compression": 259, "strips": 273, "samples": 277, "strip_rows": 278, "strip_sizes": 279, "planar": 284, "predictor": 317, "tile_width": 322, "tile_height": 323,
    "tiles": 324, "tile_sizes": 325, "format": 339, "scale": 33550, "tie": 33922, "keys": 34735, "metadata": 42112, "no_value": 42113,
}
MODEL, RASTER, GEOGRAPHIC, PROJECTED = 1024, 1025, 2048, 3072
OFFSETS = {"HORIZONTAL_OFFSET": "horizontal", "GEOGRAPHIC_3D_OFFSET": "horizontal", "VERTICAL_OFFSET_GEOGRAPHIC_TO_VERTICAL": "vertical", "ELLIPSOIDAL_HEIGHT_OFFSET": "ellipsoidal", "VELOCITY": "deformation"}


class TiffError(ValueError):
    """A file that isn't a grid of the kinds above."""


def directories(data: bytes) -> list[dict[str, tuple]]:
    """The fields of each image, by name."""
    if data[:2] not in (b"II", b"MM"):
        raise TiffError("no TIFF header")
    order = "<" if data[:2] == b"II" else ">"

    def unpack(form: str, at: int) -> tuple:
        return struct.unpack(order + form, data[at : at + struct.calcsize(order + form)])

    version, = unpack("H", 2)
    if version not in (42, 43):
        raise TiffError("no TIFF header")
    # the later form has wide counts and places
    count, entry, wide, at = ("H", 12, "I", 4) if version == 42 else ("Q", 20, "Q", 8)
    names, out = {v: k for k, v in TAGS.items()}, []
    place, = unpack(wide, at)
    while place:
        n, = unpack(count, place)
        place += struct.calcsize(count)
        fields: dict[str, tuple] = {"order": (order,)}
        for k in range(n):
            begin = place + k * entry
            tag, kind, values = unpack("HH" + wide, begin)
            if tag not in names or kind not in KINDS:
                continue
            size, code = KINDS[kind]
            held = begin + 4 + struct.calcsize(wide)
            if size * values > struct.calcsize(wide):
                held, = unpack(wide, held)
            if code == "s":
                fields[names[tag]] = (data[held : held + values].split(b"\0")[0].decode("utf-8", "replace"),)
            else:
                fields[names[tag]] = unpack(f"{values}{code}", held)
        out.append(fields)
        place, = unpack(wide, place + n * entry)
    return out


def unpacked_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first, widened one code early."""
    out, table = [], []
    old, held, bits, width = b"", 0, 0, 9
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, old, width = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
            continue
        if not table or code > len(table) or code == len(table) and not old:
            raise TiffError("a code beyond the table")
        new = table[code] if code < len(table) else old + old[:1]
        if old:
            table.append(old + new[:1])
        out.append(new)
        old = new
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def raster(data: bytes, f: dict[str, tuple], first: int = 0, last: int | None = None) -> np.ndarray:
    """rows x columns x samples, of the rows from first to last."""
    columns, rows, samples = f["width"][0], f["height"][0], f.get("samples", (1,))[0]
    last = rows if last is None else last
    kind, bits, order = f.get("format", (1,))[0], f.get("bits", (1,))[0], f["order"][0]
    if kind != 3 or bits not in (32, 64):
        raise TiffError("samples are single or double floats")
    size = bits // 8
    planar = f.get("planar", (1,))[0] == 2
    if "tiles" in f:
        w, h, places, sizes = f["tile_width"][0], f["tile_height"][0], f["tiles"], f["tile_sizes"]
    else:
        w, h, places, sizes = columns, min(rows, f.get("strip_rows", (rows,))[0]), f["strips"], f["strip_sizes"]
    across, down, each = -(-columns // w), -(-rows // h), 1 if planar else samples
    packing, predictor = f.get("compression", (1,))[0], f.get("predictor", (1,))[0]
    out = np.full((last - first, columns, samples), np.nan)
    for k, (place, length) in enumerate(zip(places, sizes, strict=True)):
        top = k % (across * down) // across * h
        if top >= last or top + h <= first:
            continue
        part = data[place : place + length]
        if packing == 5:
            part = unpacked_lzw(part)
        elif packing in (8, 32946):
            part = zlib.decompress(part)
        elif packing != 1:
            raise TiffError(f"compression {packing}")
        band, k = divmod(k, across * down) if planar else (0, k)
        top, left = k // across * h, k % across * w
        high = h if "tiles" in f else min(h, rows - top)
        if len(part) < high * w * each * size:
            raise TiffError("a strip or tile breaks off")
        part = part[: high * w * each * size]
        if predictor == 3:  # differences of bytes along a row, the high bytes of all numbers first
            bytes_ = np.cumsum(np.frombuffer(part, np.uint8).reshape(high, -1, each), axis=1, dtype=np.uint8).reshape(high, size, w * each)
            block = np.ascontiguousarray(bytes_.transpose(0, 2, 1)).view(f">f{size}").reshape(high, w, each)
        elif predictor == 1:
            block = np.frombuffer(part, f"{order}f{size}").reshape(high, w, each)
        else:
            raise TiffError(f"predictor {predictor}")
        block = block[: rows - top, : columns - left][max(0, first - top) : last - top]
        top = max(0, top - first)
        out[top : top + block.shape[0], left : left + block.shape[1], band : band + each] = block
    return out


def described(text: str) -> tuple[dict[str, str], dict[int, dict[str, str]]]:
    """Items of the metadata: of the image, and by sample."""
    whole: dict[str, str] = {}
    by: dict[int, dict[str, str]] = {}
    for item in ElementTree.fromstring(text).iter("Item") if text.strip() else ():
        key = (item.get("role") if item.get("role") in ("description", "unittype", "scale", "offset") else item.get("name") or "").lower()
        if item.get("sample") is None:
            whole[key] = (item.text or "").strip()
        else:
            by.setdefault(int(item.get("sample")), {})[key] = (item.text or "").strip()
    return whole, by


#: Seconds of arc in a unit of angle.
SECONDS = {"arc-second": 1.0, "arc-seconds per year": 1.0, "degree": 3600.0, "radian": 180 * 3600 / math.pi}


def image(name: str, data: bytes, f: dict[str, tuple], inherited: tuple[dict, dict] | None) -> tuple[Head, tuple[dict, dict]]:
    """A grid; what the metadata doesn't say holds as for the image before."""
    if len(f.get("scale", ())) < 2 or len(f.get("tie", ())) < 6:
        raise TiffError("scale and tie point are needed")
    whole, by = described(f.get("metadata", ("",))[0])
    if inherited:
        whole = inherited[0] | whole
        by = {k: inherited[1].get(k, {}) | by.get(k, {}) for k in inherited[1].keys() | by.keys()}
    keys = f.get("keys", ())
    geo = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
    projected = geo[MODEL] == 1 if MODEL in geo else PROJECTED in geo and GEOGRAPHIC not in geo
    names = {v.get("description", "").lower(): k for k, v in by.items()}
    find = lambda *wanted: next((names[w] for w in wanted if w in names), None)
    kind = OFFSETS.get(whole.get("type", "HORIZONTAL_OFFSET").upper())
    if kind is None:
        raise TiffError(f"type {whole.get('type')}")

    def scaled(values: np.ndarray, k: int, positive: str) -> np.ndarray:
        item = by.get(k, {})
        v = values[..., k] * float(item.get("scale", 1) or 1) + float(item.get("offset", 0) or 0) + float(item.get("constant_offset", 0) or 0)
        unit = SECONDS.get(item.get("unittype", "").lower(), 1.0)
        return (v if item.get("positive_value", positive).lower() == positive else -v) * unit

    # the sample of each band, and its positive direction (None: taken as it is)
    if kind == "deformation":
        plan = [(i if k is None else k, None) for i, k in enumerate((find("east_velocity"), find("north_velocity"), find("up_velocity")))]
    elif kind in ("vertical", "ellipsoidal"):
        plan = [(find("geoid_undulation", "hydroid_height", "ellipsoidal_height_offset", "vertical_offset") or 0, "")]
    else:
        lat, lon = find("latitude_offset", "northing_offset"), find("longitude_offset", "easting_offset")
        plan = [(1 if lon is None else lon, "east"), (0 if lat is None else lat, "north")]
        up = find("ellipsoidal_height_offset")
        plan += [] if up is None else [(up, None)]

    def nodes(first: int, last: int) -> np.ndarray:
        values = raster(data, f, first, last)
        if "no_value" in f:
            values[values == float(f["no_value"][0])] = np.nan
        return np.stack([values[..., k] if positive is None else scaled(values, k, positive) for k, positive in plan], axis=-1)

    unit = 1.0 if projected else math.pi / 180
    dlon, dlat = f["scale"][0], f["scale"][1]
    half = 0.5 if geo.get(RASTER) == 1 else 0.0  # samples stand for areas: nodes are their middles
    north, west = f["tie"][4] - half * dlat, f["tie"][3] + half * dlon
    head = Head(whole.get("grid_name", name), north * unit, west * unit, dlat * unit, dlon * unit, f["height"][0], f["width"][0], len(plan), kind, projected, nodes)
    return head, (whole, by)


class WithHeights:
    """A horizontal grid and a grid of heights, each interpolated at the point itself."""

    def __init__(self, flat: Grid, heights: Grid):
        self.flat, self.heights, self.name = flat, heights, flat.name
        self.bands, self.kind, self.projected = 3, flat.kind, flat.projected

    def contains(self, lon, lat, margin: float = 0.0):
        return self.flat.contains(lon, lat, margin)

    def at(self, lon, lat, margin: float = 0.0):
        return np.concatenate((self.flat.at(lon, lat, margin), self.heights.at(lon, lat, 0.5)), axis=-1)


def heads(name: str, data: bytes) -> list[Head]:
    """The images as grids; one that lies within a coarser one before it is a part of that."""
    out: list[Head] = []
    meta = None
    for fields in directories(data):
        head, meta = image(name, data, fields, meta)
        around = [k for k, h in enumerate(out) if h.kind == head.kind and h.dlat >= head.dlat and h.holds(head)]
        out.append(replace(head, parent=around[-1] if around else -1))
    if not out:
        raise TiffError(f"{name}: no image")
    if len(out) == 1:
        out[0].name = name
    return out


def geotiff(name: str, data: bytes) -> Grid | WithHeights:
    images = heads(name, data)
    if len(images) == 2 and images[0].bands == 2 and images[1].kind == "ellipsoidal":
        return WithHeights(*(h.grid() for h in images))
    return whole(name, images)
