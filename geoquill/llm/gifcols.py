"""Media columns: GIF.

`decode` turns a column of GIF bytes into timed frames: LZW code streams are expanded, colour tables applied, and
frames composed on the canvas under the disposal and transparency rules (interlaced ones put in order). Each frame is
stored with its place, start and delay, samples, pixels on the canvas, and a colour histogram. `encode` stores
payloads as GIFs: rows of 192 samples, up to 64 rows a frame, a grey colour table that can be inverted, LZW
compression.

Rows are independent: nothing is shuffled, and a worker holds one Arrow batch and one medium at a time.

Edge cases: null text counts as empty (one row of 192 spaces); null media give no frames; media that are no GIF or
break off (also without a trailer), and media whose canvas is larger than their bytes could ever fill, raise no error
but give the frames that are whole and a note in `error`. Repeated rows are stored each. An
empty table gives an empty table. Input columns with the names of output columns are replaced. Very long payloads
become many frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import quoted, without

WIDTH, ROWS, DELAY, BINS = 192, 64, 10, 16
CLEAR, END, FULL = 256, 257, 4096
GREY = bytes(v for b in range(256) for v in (b, b, b))


def _widths(size: int, n: int) -> np.ndarray:
    """Bits of the code that comes m-th after a clear code: the table grows by one with each code but the first."""
    m = np.arange(n)
    free = (1 << size) + 2 + np.maximum(0, m - 1)
    return np.minimum(12, np.maximum(size + 1, np.floor(np.log2(free)).astype(int) + 1))


_WIDTHS = {s: _widths(s, FULL + 8) for s in range(2, 9)}
_PLACES = {s: np.concatenate(([0], np.cumsum(w))) for s, w in _WIDTHS.items()}


def compress(samples: bytes) -> bytes:
    """8-bit samples as an LZW code stream with a clear code at its start and wherever the table is full."""
    table: dict[int, int] = {}
    free, out = END + 1, [CLEAR]
    prefix, put, get = samples[0], out.append, table.get
    for b in samples[1:]:
        k = prefix << 8 | b
        code = get(k)
        if code is not None:
            prefix = code
            continue
        put(prefix)
        if free < FULL:
            table[k] = free
            free += 1
        else:
            put(CLEAR)
            table.clear()
            free = END + 1
        prefix = b
    out += [prefix, END]
    codes = np.array(out, np.int64)
    # how many codes came since the last clear code, which has the width of what would follow
    at = np.arange(len(codes))
    clears = np.flatnonzero(codes == CLEAR)
    since = at - clears[np.searchsorted(clears, at, "left") - 1] - 1
    since[0] = 0
    widths = _WIDTHS[8][since]
    ends = np.cumsum(widths)
    places = ends - widths
    values = codes << (places & 7)
    n = int(ends[-1] + 7) // 8
    total = np.zeros(n + 3, np.int64)
    for k in range(3):
        total += np.bincount((places >> 3) + k, (values >> 8 * k) & 255, n + 3).astype(np.int64)
    return total[:n].astype(np.uint8).tobytes()


def expand(data: bytes, size: int, want: int) -> bytes:
    """The samples of an LZW code stream with codes from size + 1 bits on, `want` at most."""
    clear, end = 1 << size, (1 << size) + 1
    padded = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    bits = 8 * len(data)
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    got, at, widths, starts = 0, 0, _WIDTHS[size], _PLACES[size]
    while got < want and at < bits:
        # codes from here on if no clear code came: their widths depend on their number alone
        fit = int(np.searchsorted(starts, bits - at, "right")) - 1
        if fit <= 0:
            break
        places = at + starts[: fit + 1]
        first, shift = places[:-1] >> 3, places[:-1] & 7
        codes = ((padded[first] | padded[first + 1] << 8 | padded[first + 2] << 16) >> shift) & ((1 << widths[:fit]) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        if not len(stop) and fit == len(widths):  # an encoder that goes on with a full table
            widths = np.concatenate((widths, np.full(bits // 12, 12)))
            starts = np.concatenate(([0], np.cumsum(widths)))
            continue
        last = int(stop[0]) if len(stop) else fit
        table, old = roots.copy(), b""
        add = table.append
        for code in codes[:last].tolist():
            try:
                new = table[code]
            except IndexError:
                if code != len(table) or not old:
                    raise ValueError("a code beyond the table") from None
                new = old + old[:1]
            if old and len(table) < FULL:
                add(old + new[:1])
            out.append(new)
            old = new
        got = sum(map(len, out))
        if not len(stop) or codes[last] == end:
            break
        at = int(places[last + 1])
    return b"".join(out)[:want]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode_gif(payload: bytes) -> bytes:
    """A payload of whole rows as a GIF; sample b has the colour (b, b, b)."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), GREY]
    for top in range(0, rows, ROWS):
        part = payload[top * WIDTH : (top + ROWS) * WIDTH]
        control = b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, DELAY, 0, 0)  # do not dispose, no transparency
        image = b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08"
        out += [control, image, _blocks(compress(part))]
    return b"".join([*out, b"\x3b"])


def _interlaced(rows: int) -> list[int]:
    return [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, rows, step)]


def decode_gif(media: bytes) -> Iterator[dict]:
    """Frames in order: left, top, width, height, start and delay in hundredths of a second, samples (palette
    indices) and canvas (height x width x RGBA) once the frame is drawn."""
    if media[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", media, 6)
    at = 13
    shared = None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = np.frombuffer(media, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n

    def gathered(at: int) -> tuple[bytes, int]:
        parts = []
        while n := media[at]:
            parts.append(media[at + 1 : at + 1 + n])
            at += 1 + n
        return b"".join(parts), at + 1

    # a code of 3 bits or more stands for less than FULL samples
    if width * height > FULL * 8 * len(media) // 3:
        raise ValueError("a canvas that no frame could fill")
    canvas = np.zeros((height, width, 4), np.uint8)
    disposal, delay, hidden, start = 0, 0, None, 0
    while at < len(media) and media[at] != 0x3B:
        if media[at] == 0x21:
            if media[at + 1] == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", media, at + 3)
                disposal, hidden = packed >> 2 & 7, index if packed & 1 else None
            _, at = gathered(at + 2)
            continue
        if media[at] != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", media, at + 1)
        at += 10
        colours = shared
        if packed & 0x80:
            n = 2 << (packed & 7)
            colours = np.frombuffer(media, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        size = media[at]
        if not 2 <= size <= 8:
            raise ValueError("a code size that isn't")
        data, at = gathered(at + 1)
        samples = expand(data, size, w * h)
        if len(samples) < w * h or colours is None:
            raise ValueError("a frame breaks off")
        grid = np.frombuffer(samples, np.uint8).reshape(h, w)
        if packed & 0x40:
            ordered = np.empty_like(grid)
            ordered[_interlaced(h)] = grid
            grid = ordered
        before = canvas.copy() if disposal == 3 else None
        seen = grid[: max(0, height - top), : max(0, width - left)]
        view = canvas[top : top + h, left : left + w]
        if len(colours) < 256:
            seen = np.minimum(seen, len(colours) - 1) if hidden is None else np.where(seen == hidden, hidden, np.minimum(seen, len(colours) - 1))
        painted = np.concatenate((colours, np.full((len(colours), 1), 255, np.uint8)), axis=1)
        if hidden is None:
            view[:] = painted[seen]
        else:
            drawn = seen != hidden
            view[drawn] = painted[np.minimum(seen[drawn], len(colours) - 1)]
        yield {"left": left, "top": top, "width": w, "height": h, "start": start, "delay": delay, "samples": grid.tobytes(), "canvas": canvas}
        start += delay
        if disposal == 2:
            view[:] = 0
        elif disposal == 3:
            canvas = before
        disposal, delay, hidden = 0, 0, None
    if at >= len(media):
        raise ValueError("no trailer")


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Counts of visible pixels by 16 levels of each of red, green and blue, 48 numbers."""
    pixels = canvas.reshape(-1, 4)
    levels = pixels[:, :3] >> 4
    if not pixels[:, 3].all():
        levels = levels[pixels[:, 3] > 0]
    return np.bincount((levels + np.arange(0, 3 * BINS, BINS, dtype=np.uint8)).ravel(), minlength=3 * BINS)


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b" ")


def encode(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs but the text, and n_bytes and media: the text's bytes, filled up with spaces, as a GIF."""
    keep = [c for c in without(docs, ["n_bytes", "media"]) if c != text]
    rows = docs.select(*[quoted(c) for c in keep], quoted(text))
    schema = T.StructType([f for f in rows.schema.fields if f.name != text] + [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                made = [payload(t.as_py()) for t in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array([n for n, _ in made], pa.int64()), pa.array([encode_gif(p) for _, p in made], pa.binary())], names=[*keep, "n_bytes", "media"])

    return rows.mapInArrow(run, schema)


FRAME = T.StructType([T.StructField(n, T.IntegerType()) for n in ("left", "top", "width", "height", "start", "delay")] + [T.StructField("samples", T.BinaryType()), T.StructField("histogram", T.ArrayType(T.LongType()))])
FRAMES = T.StructField("frames", T.ArrayType(FRAME))


def decode(media: DataFrame, column: str = "media") -> DataFrame:
    """All columns of the input but the media, and frames (timed, with samples and colour histogram), media_bytes,
    media_sha256, payload_sha256, payload_bytes, tail_crc32 (of the samples of all frames, end to end) and error."""
    out = ["frames", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "error"]
    keep = [c for c in without(media, out) if c != column]
    rows = media.select(*[quoted(c) for c in keep], quoted(column))
    more = [FRAMES, T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("error", T.StringType())]
    schema = T.StructType([f for f in rows.schema.fields if f.name != column] + more)
    fields = [pa.field(n, pa.int32()) for n in ("left", "top", "width", "height", "start", "delay")] + [pa.field("samples", pa.binary()), pa.field("histogram", pa.list_(pa.int64()))]
    kinds = [pa.list_(pa.struct(fields)), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def read(data: bytes | None) -> tuple:
        frames, error = [], None
        try:
            for f in decode_gif(data) if data is not None else ():
                frames.append({k: f[k] for k in ("left", "top", "width", "height", "start", "delay", "samples")} | {"histogram": histogram(f["canvas"]).tolist()})
        except (ValueError, LookupError, struct.error) as e:
            error = str(e)
        back = b"".join(f["samples"] for f in frames)
        return frames, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data or b""), hashlib.sha256(data or b"").hexdigest(), error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                made = list(zip(*[read(m.as_py()) for m in part.column(len(keep))], strict=True))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(list(v), k) for v, k in zip(made, kinds, strict=True))], names=[*keep, *out])

    return rows.mapInArrow(run, schema)
