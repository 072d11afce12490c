"""Transformations and conversions of coordinates."""

from __future__ import annotations

import math

from ..functions.ellipsoid import Ellipsoid
from ..plans.parameters import Params
from ..plans.registry import Op, operator

#: Metres of linear units, radians of angular ones.
LINEAR = {
    "km": 1000.0, "m": 1.0, "dm": 0.1, "cm": 0.01, "mm": 0.001, "kmi": 1852.0, "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "mi": 1609.344, "fath": 1.8288, "ch": 20.1168, "link": 0.201168,
    "us-in": 100 / 3937, "us-ft": 1200 / 3937, "us-yd": 3600 / 3937, "us-ch": 79200 / 3937, "us-mi": 6336000 / 3937, "ind-yd": 0.91439523, "ind-ft": 0.30479841, "ind-ch": 20.11669506,
}
ANGULAR = {"rad": 1.0, "deg": math.pi / 180, "grad": math.pi / 200}
AXES = {"e": (0, 1), "n": (1, 1), "u": (2, 1), "f": (3, 1), "w": (0, -1), "s": (1, -1), "d": (2, -1), "p": (3, -1)}


def _moved(source, sign_and_unit):
    """An operator whose element i is element source[i] times a factor; factors of 1 leave no trace."""

    def fwd(m, *c):
        return tuple(c[s] if k == 1 else c[s] * k for s, k in zip(source, sign_and_unit, strict=True))

    def inv(m, *c):
        out = [None] * 4
        for i, (s, k) in enumerate(zip(source, sign_and_unit, strict=True)):
            out[s] = c[i] if k == 1 else c[i] * (1.0 / k)
        return tuple(out)

    return Op(fwd, inv)


def _order(p: Params, text: str) -> tuple[list[int], list[float]]:
    """For each element of a described order, the internal axis it holds, and the factor that makes it internal."""
    if text == "pass":
        text = "enuf"
    axes, _, unit = text.partition("_")
    if len(axes) != 4 or any(a not in AXES for a in axes) or unit not in ("", "deg", "gon", "rad", "any"):
        raise p.fail(f"bad order: {text}")
    which = [AXES[a][0] for a in axes]
    if sorted(which) != [0, 1, 2, 3]:
        raise p.fail(f"no permutation: {text}")
    angle = {"deg": math.pi / 180, "gon": math.pi / 200}.get(unit, 1.0)
    return which, [AXES[a][1] * (angle if AXES[a][0] < 2 else 1.0) for a in axes]


@operator("adapt")
def adapt(p: Params) -> Op:
    source, factor = _order(p, p.text("from", "enuf"))
    goal, divisor = _order(p, p.text("to", "enuf"))
    where = [source.index(axis) for axis in goal]
    return _moved(where, [factor[w] / d for w, d in zip(where, divisor, strict=True)])


@operator("axisswap")
def axisswap(p: Params) -> Op:
    order = p.series("order")
    if len(order) > 4 or sorted(map(abs, order)) != list(range(1, len(order) + 1)):
        raise p.fail("order is a signed permutation of the first axes")
    source = [int(abs(v)) - 1 for v in order] + list(range(len(order), 4))
    return _moved(source, [math.copysign(1.0, v) for v in order] + [1.0] * (4 - len(order)))


@operator("unitconvert")
def unitconvert(p: Params) -> Op:
    def factor(a: str, b: str) -> float:
        a, b = p.text(a, "m"), p.text(b, "m")

        def unit(name: str) -> tuple[str, float]:
            if name in LINEAR:
                return "linear", LINEAR[name]
            if name in ANGULAR:
                return "angular", ANGULAR[name]
            try:
                value = float(name)
            except ValueError:
                value = math.nan
            if not (math.isfinite(value) and value > 0):
                raise p.fail(f"no unit: {name}")
            return "any", value

        (k1, v1), (k2, v2) = unit(a), unit(b)
        if {k1, k2} == {"linear", "angular"}:
            raise p.fail(f"{a} and {b} don't agree")
        return v1 / v2

    xy, z_ = factor("xy_in", "xy_out"), factor("z_in", "z_out")
    return Op(lambda m, x, y, z, t: (x * xy, y * xy, z * z_, t), lambda m, x, y, z, t: (x / xy, y / xy, z / z_, t))


@operator("lonlat", "longlat", "latlon", "latlong")
def lonlat(p: Params) -> Op:
    lon = p.lon_0
    return Op(lambda m, x, y, z, t: (x - lon, y, z, t), lambda m, x, y, z, t: (x + lon, y, z, t))


@operator("geogoffset")
def geogoffset(p: Params) -> Op:
    """Offsets in arc seconds and metres."""
    dlon, dlat, dh = (p.real(k, 0.0) for k in ("dlon", "dlat", "dh"))
    dlon, dlat = (math.radians(v / 3600) for v in (dlon, dlat))
    return Op(lambda m, x, y, z, t: (x + dlon, y + dlat, z + dh, t), lambda m, x, y, z, t: (x - dlon, y - dlat, z - dh, t))


@operator("cart")
def cart(p: Params) -> Op:
    """Geographic to geocentric cartesian coordinates. Time plays no part, so a missing one is no failure."""
    ellps = p.ellps()

    def fwd(m, x, y, z, t):
        return (*ellps.cartesian(m, *m.let(x, y, z)), t)

    def inv(m, x, y, z, t):
        return (*ellps.geographic(m, *m.let(x, y, z)), t)

    return Op(fwd, inv)


@operator("latitude")
def latitude(p: Params) -> Op:
    mode, e = p.one_of("geocentric", "reduced", "parametric", "conformal", "authalic", "rectifying"), p.ellps()
    there, back = {
        "geocentric": (e.geocentric, e.from_geocentric),
        "reduced": (e.reduced, e.from_reduced),
        "parametric": (e.reduced, e.from_reduced),
        "conformal": (lambda m, a: e.along(m, e.conformal[0], a), lambda m, a: e.along(m, e.conformal[1], a)),
        "authalic": (lambda m, a: e.along(m, e.authalic[0], a), lambda m, a: e.along(m, e.authalic[1], a)),
        "rectifying": (lambda m, a: e.arc(m, a) / e.a, lambda m, a: e.lat_of_arc(m, a * e.a)),
    }[mode]
    return Op(lambda m, x, y, z, t: (x, there(m, y), z, t), lambda m, x, y, z, t: (x, back(m, y), z, t))


@operator("permtide")
def permtide(p: Params) -> Op:
    k, ellps = p.real("k", 0.3), p.ellps()
    # how much of the tide's permanent effect each system leaves in heights
    level = {"mean": 0.0, "zero": -1.0, "free": -(1.0 + k)}
    try:
        coefficient = (level[p.text("to")] - level[p.text("from")]) * -0.198
    except KeyError:
        raise p.fail("from and to are mean, zero or free") from None

    def shift(m, y):
        s = m.let(m.sin(ellps.geocentric(m, y)))
        return coefficient * (1.5 * s * s - 0.5)

    return Op(lambda m, x, y, z, t: (x, y, z + shift(m, y), t), lambda m, x, y, z, t: (x, y, z - shift(m, y), t))


@operator("molodensky")
def molodensky(p: Params) -> Op:
    """The inverse subtracts the shift at the target, so it is no exact inverse."""
    dx, dy, dz, abridged = p.real("dx"), p.real("dy"), p.real("dz"), p.flag("abridged")
    if "ellps_0" in p and "ellps_1" in p:
        e, goal = p.ellps("ellps_0"), p.ellps("ellps_1")
        da, df = goal.a - e.a, goal.f - e.f
    else:
        e, da, df = p.ellps(), p.real("da"), p.real("df")

    def shift(m, x, y, z):
        sl, cl, s, c = m.let(m.sin(x), m.cos(x), m.sin(y), m.cos(y))
        n, r = m.let(e.prime_vertical(m, y), e.meridian(m, y))
        fac = m.let(dx * cl + dy * sl)
        if abridged:
            adffda = e.a * df + e.f * da
            lat = (-fac * s + dz * c + adffda * m.sin(2 * y)) / r
            return (dy * cl - dx * sl) / (n * c), lat, fac * c + (dz + adffda * s) * s - da
        lat = (dz + n * (e.es * da / e.a) * s) * c - fac * s + (r / (1 - e.f) + n * (1 - e.f)) * df * s * c
        h = fac * c + dz * s - (e.a * da) / n + n * ((1 - e.f) * df) * s * s
        return (dy * cl - dx * sl) / ((n + z) * c), lat / (r + z), h

    def fwd(m, x, y, z, t):
        a, b, c = shift(m, x, y, z)
        return x + a, y + b, z + c, t

    def inv(m, x, y, z, t):
        a, b, c = shift(m, x, y, z)
        return x - a, y - b, z - c, t

    return Op(fwd, inv)


# -- similarity transformations ---------------------------------------------------------------


def _triple(p: Params, name: str, keys: tuple[str, str, str]) -> list[float]:
    """Three numbers: a list under one name, each overridden by its own key where that isn't zero."""
    whole = p.series(name, (0.0, 0.0, 0.0))
    if len(whole) != 3:
        raise p.fail(f"{name} takes three numbers")
    return [v or w for v, w in zip((p.real(k, 0.0) for k in keys), whole, strict=True)]


def _rotation(m, r, exact: bool, position_vector: bool):
    """Rows of the rotation matrix for angles in radians, numbers or columns."""
    rx, ry, rz = r
    if exact:
        sx, sy, sz, cx, cy, cz = m.let(m.sin(rx), m.sin(ry), m.sin(rz), m.cos(rx), m.cos(ry), m.cos(rz))
        rows = [[cy * cz, cx * sz + sx * sy * cz, sx * sz - cx * sy * cz], [-(cy * sz), cx * cz - sx * sy * sz, sx * cz + cx * sy * sz], [sy, -(sx * cy), cx * cy]]
    else:
        rows = [[1.0, rz, -ry], [-rz, 1.0, rx], [ry, -rx, 1.0]]
    # coordinate frame as built; position vector is its transpose
    return [list(col) for col in zip(*rows, strict=True)] if position_vector else rows


def _convention(p: Params, needed: bool) -> bool:
    if not needed and "convention" not in p:
        return True
    text = p.text("convention", "") if needed else p.text("convention")
    if text not in ("position_vector", "coordinate_frame"):
        raise p.fail("convention is position_vector or coordinate_frame")
    return text == "position_vector"


@operator("helmert")
def helmert(p: Params) -> Op:
    """3, 7, 14 or 15 parameters, or 4 in the plane (with theta); rates hold from t_epoch."""
    if p.flag("transpose"):
        raise p.fail("transpose isn't supported")
    if "towgs84" in p:
        raise p.fail("towgs84 isn't supported; give the parameters themselves")
    length = 0.001 if p.flag("mm") else 1.0
    turn = math.radians((1e-6 if p.flag("uas") else 1.0) / 3600)
    if "theta" in p:
        return _plane(p, length)
    move = [v * length for v in _triple(p, "translation", ("x", "y", "z"))]
    rates = [v * length for v in _triple(p, "velocity", ("dx", "dy", "dz"))]
    if "translation_rate" in p:
        rates = [v * length for v in _triple(p, "translation_rate", ("dx", "dy", "dz"))]
    spin = [v * turn for v in _triple(p, "rotation", ("rx", "ry", "rz"))]
    spin_rates = [v * turn for v in _triple(p, "rotation_rate", ("drx", "dry", "drz"))]
    scale = p.real("scale", 0.0) if "scale" in p else p.real("s", 0.0)
    scale_rate = p.real("scale_rate", 0.0) if "scale_rate" in p else p.real("ds", 0.0)
    rotated, exact = any(spin) or any(spin_rates), p.flag("exact")
    vector = _convention(p, rotated)
    dynamic = any(rates) or any(spin_rates) or scale_rate != 0
    epoch = p.real("t_epoch", math.nan)
    if dynamic and math.isnan(epoch):
        raise p.fail("t_epoch is needed with rates")
    if dynamic and "t_obs" in p:  # the parameters at a fixed time
        dt = p.real("t_obs") - epoch
        move, spin = ([v + dt * d for v, d in zip(a, b, strict=True)] for a, b in ((move, rates), (spin, spin_rates)))
        scale, dynamic = scale + dt * scale_rate, False

    return similarity(move, rates if dynamic else None, spin, spin_rates, scale, scale_rate, epoch, exact, vector, rotated)


def similarity(move, rates, spin, spin_rates, scale, scale_rate, epoch, exact: bool, vector: bool, rotated: bool = True) -> Op:
    """By parameters that are numbers or values of columns; rates (if any) hold from the epoch. Angles in radians, scale
    in parts per million."""
    dynamic = rates is not None

    def at(m, t):
        if not dynamic:
            return move, spin, 1 + scale * 1e-6
        dt = m.let(m.where(m.isnan(t), 0.0, t - epoch))
        moving = lambda v, d: v + dt * d if d else v
        return [moving(v, d) for v, d in zip(move, rates, strict=True)], [moving(v, d) for v, d in zip(spin, spin_rates, strict=True)], 1 + (scale + dt * scale_rate if scale_rate else scale) * 1e-6

    def turned(m, r, c, back: bool):
        if not rotated:
            return c
        rows = _rotation(m, r, exact, vector != back)
        return [row[0] * c[0] + row[1] * c[1] + row[2] * c[2] for row in rows]

    def fwd(m, x, y, z, t):
        go, r, s = at(m, t)
        return (*(s * v + g for v, g in zip(turned(m, r, [x, y, z], False), go, strict=True)), t)

    def inv(m, x, y, z, t):
        go, r, s = at(m, t)
        return (*turned(m, r, m.let(*((v - g) / s for v, g in zip((x, y, z), go, strict=True))), True), t)

    return Op(fwd, inv)


def _plane(p: Params, length: float) -> Op:
    theta, s = math.radians(p.real("theta") / 3600), p.real("s", 1.0)
    dx, dy = (p.real(k, 0.0) * length for k in ("x", "y"))
    c, d = s * math.cos(theta), s * math.sin(theta)
    fwd = lambda m, x, y, z, t: (c * x + d * y + dx, -d * x + c * y + dy, z, t)

    def inv(m, x, y, z, t):
        u, v = m.let(x - dx, y - dy)
        return (c * u - d * v) / (s * s), (d * u + c * v) / (s * s), z, t

    return Op(fwd, inv)


@operator("molobadekas")
def molobadekas(p: Params) -> Op:
    """A similarity about a pivot."""
    length = 0.001 if p.flag("mm") else 1.0
    turn = math.radians((1e-6 if p.flag("uas") else 1.0) / 3600)
    move = [p.real(k, 0.0) * length for k in "xyz"]
    spin = [p.real(k, 0.0) * turn for k in ("rx", "ry", "rz")]
    pivot = [p.real(k, 0.0) for k in ("px", "py", "pz")]
    scale = p.real("s", 0.0)
    if not any(move + spin + [scale]):
        raise p.fail("no parameter is given")
    vector, s, exact = _convention(p, any(spin)), 1 + scale * 1e-6, p.flag("exact")

    def fwd(m, x, y, z, t):
        c = m.let(*(v - o for v, o in zip((x, y, z), pivot, strict=True)))
        rows = _rotation(m, spin, exact, vector)
        return (*((row[0] * c[0] + row[1] * c[1] + row[2] * c[2]) * s + o + g for row, o, g in zip(rows, pivot, move, strict=True)), t)

    def inv(m, x, y, z, t):
        c = m.let(*((v - o - g) / s for v, o, g in zip((x, y, z), pivot, move, strict=True)))
        rows = _rotation(m, spin, exact, not vector)
        return (*(row[0] * c[0] + row[1] * c[1] + row[2] * c[2] + o for row, o in zip(rows, pivot, strict=True)), t)

    return Op(fwd, inv)


