"""PROJ strings as pipelines of this language."""

from __future__ import annotations

import math
import re

from ..functions.angles import MERIDIANS, parse
from ..functions.ellipsoid import Ellipsoid
from .language import PipelineError, normalize

ALIASES = {"hgridshift": "gridshift", "etmerc": "tmerc", "longlat": "lonlat", "latlon": "lonlat", "latlong": "lonlat", "geocent": "cart", "sterec": "stere"}
AXES = {"e": 1, "w": -1, "n": 2, "s": -2, "u": 3, "d": -3}


def native(text: str) -> str:
    """The text itself unless it is a PROJ string (`proj=` and no bar)."""
    if "|" in text or not re.search(r"(^|[\s+])proj\s*=", text):
        return text
    text = " " + normalize(re.sub(r"(^|\s)\+", r"\1", text)) + " "
    chunks = [c.split() for c in re.split(r" step(?= )", text) if c.strip()]
    common, turned, steps = [], False, []
    for k, words in enumerate(chunks):
        if any(w.startswith("init=") for w in words):
            raise PipelineError("init isn't supported")
        if "proj=pipeline" in words:
            if k:
                raise PipelineError("PROJ pipelines don't nest")
            words.remove("proj=pipeline")
            turned = "inv" in words
            common = [w for w in words if w != "inv"]
            continue
        steps.append(words)
    out = [_step(words, common, turned) for words in steps]
    return " | ".join(reversed(out) if turned else out)


def _step(words: list[str], common: list[str], turned: bool) -> str:
    given: dict[str, str] = {}
    for w in [*common, *words]:
        key, _, value = w.partition("=")
        given[key] = value if "=" in w else "true"
    try:
        name = given.pop("proj")
    except KeyError:
        raise PipelineError(f"no proj in {' '.join(words)}") from None
    name = ALIASES.get(name, name)
    inverse = (given.pop("inv", None) is not None) != turned
    if turned:  # seen from the other end
        ends = {"omit_fwd": "omit_inv", "omit_inv": "omit_fwd"}
        given = {ends.get(k, k): v for k, v in given.items()}
    for k in ("no_defs", "type", "wktext", "units", "to_meter") if given.get("units", "m") == "m" else ("no_defs", "type", "wktext"):
        given.pop(k, None)
    if name == "geoc":
        name = "latitude"
        given["geocentric"] = "true"
    if name == "aeqd" and given.pop("guam", None):
        name = "guam_aeqd"
    if name == "ups":
        given.setdefault("ellps", "WGS84")
    if name == "omerc":
        for new, old in (("latc", "lat_0"), ("gamma_c", "gamma")):
            if old in given:
                given.setdefault(new, given[old])
        given.pop("gamma", None)
    if "k" in given:
        given["k_0"] = given.pop("k")
    _ellipsoid(given)
    _meridian(given)
    swap = None
    if "axis" in given and name not in ("krovak", "mod_krovak"):
        try:
            order = [AXES[a] for a in given.pop("axis")]
        except KeyError:
            raise PipelineError("axis has the letters e, w, n, s, u, d") from None
        swap = "axisswap order=" + ",".join(map(str, order))
    step = " ".join([name, *(["inv"] if inverse else []), *(k if v == "true" else f"{k}={v}" for k, v in given.items())])
    if swap is None:
        return step
    return f"{swap} inv | {step}" if inverse else f"{step} | {swap}"


def _ellipsoid(given: dict[str, str]) -> None:
    """Datums, shapes and reductions to a sphere, as one `ellps`."""
    datum = given.pop("datum", None)
    if datum:
        given.setdefault("ellps", {"WGS84": "WGS84", "NAD83": "GRS80", "NAD27": "clrk66"}.get(datum, "GRS80"))
    if "R" in given:
        given["ellps"] = f"{given.pop('R')},0"
        for k in ("a", "b", "rf", "f"):
            given.pop(k, None)
    elif "a" in given:
        a = float(given.pop("a"))
        b, rf, f = (given.pop(k, None) for k in ("b", "rf", "f"))
        flat = 1 - float(b) / a if b else 1 / float(rf) if rf and float(rf) else float(f) if f else 0.0
        given["ellps"] = f"{a!r},{1 / flat if flat else 0!r}"
    reductions = [k for k in given if k in ("R_A", "R_V", "R_a", "R_g", "R_h", "R_C", "R_lat_a", "R_lat_g")]
    if not reductions:
        return
    e, k = Ellipsoid.named(given.get("ellps", "GRS80")), reductions[0]
    value = given.pop(k)
    a, b, es = e.a, e.b, e.es
    if k in ("R_C", "R_lat_a", "R_lat_g"):
        lat = math.radians(parse(given.get("lat_0", "0") if k == "R_C" else value))
        w = 1 - es * math.sin(lat) ** 2
        n, m = a / math.sqrt(w), a * (1 - es) / (w * math.sqrt(w))
        r = (n + m) / 2 if k == "R_lat_a" else math.sqrt(n * m)
    else:
        r = {"R_A": a * math.sqrt(e.qp / 2) if es else a, "R_V": (a * a * b) ** (1 / 3), "R_a": (a + b) / 2, "R_g": math.sqrt(a * b), "R_h": 2 * a * b / (a + b)}[k]
    given["ellps"] = f"{r!r},0"


def _meridian(given: dict[str, str]) -> None:
    pm = given.pop("pm", None)
    if pm is None:
        return
    degrees = parse(MERIDIANS.get(pm.lower(), pm))
    if math.isnan(degrees):
        raise PipelineError(f"no prime meridian: {pm}")
    given["lon_0"] = repr(parse(given.get("lon_0", "0")) + degrees)
