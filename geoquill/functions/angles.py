"""Sexagesimal and ISO 6709 angles."""

from __future__ import annotations

import math

#: Longitudes of prime meridians, east of Greenwich.
MERIDIANS = {
    "greenwich": "0", "lisbon": "-9:07:54.862", "paris": "2:20:14.025", "bogota": "-74:04:51.3", "madrid": "-3:41:16.58", "rome": "12:27:08.4", "bern": "7:26:22.5",
    "jakarta": "106:48:27.79", "ferro": "-17:40", "brussels": "4:22:04.71", "stockholm": "18:03:29.8", "athens": "23:42:58.815", "oslo": "10:43:22.5", "copenhagen": "12:34:40.35",
}


def parse(text: str) -> float:
    """Degrees from d, d:m or d:m:s, with a sign or a trailing N, S, E, W; NaN if it is none."""
    text = text.strip()
    sign = 1.0
    if text and text[-1] in "nNeEsSwW":
        sign = -1.0 if text[-1] in "sSwW" else 1.0
        text = text[:-1]
    parts = text.split(":")
    if not 1 <= len(parts) <= 3:
        return math.nan
    try:
        values = [float(p or 0) if i else float(p) for i, p in enumerate(parts)]
    except ValueError:
        return math.nan
    size = abs(values[0]) + sum(v / 60**i for i, v in enumerate(values[1:], 1))
    return math.copysign(size, values[0]) * sign


def packed_to_degrees(m, value, places: int):
    """DDDMM.mmm (places 1) or DDDMMSS.sss (places 2) as degrees."""
    size = m.let(m.abs(value))
    if places == 1:
        d = m.let(m.floor(size / 100.0))
        out = d + (size - d * 100) / 60.0
    else:
        d = m.let(m.floor(size / 10000.0))
        mm = m.let(m.floor((size - d * 10000) / 100.0))
        out = d + mm / 60.0 + (size - d * 10000 - mm * 100) / 3600.0
    return m.where(value < 0, -out, out)


def degrees_to_packed(m, value, places: int):
    size = m.let(m.abs(value))
    d = m.let(m.floor(size))
    minutes = m.let((size - d) * 60)
    if places == 1:
        out = d * 100 + minutes
    else:
        mm = m.let(m.floor(minutes))
        out = d * 10000 + mm * 100 + (minutes - mm) * 60
    return m.where(value < 0, -out, out)
