"""Conic and azimuthal projections."""

from __future__ import annotations

import math

import numpy as np

from ..functions import geodesics
from ..functions.ellipsoid import Ellipsoid
from ..functions.mathx import Np, clamp, copysign, wrapped
from ..plans.parameters import Params
from ..plans.registry import Op, framed, operator, plane
from .cylindrical import authalic_inverse
from .solve import invert, root

HALF, QUARTER = math.pi / 2, math.pi / 4
TINY = 1e-10


# -- conics -----------------------------------------------------------------------------------


def cone(p: Params, phi1: float, phi2: float, secant, no_poles: bool = False) -> float:
    """The cone constant of two standard parallels."""
    if max(abs(phi1), abs(phi2)) > HALF or no_poles and min(abs(math.cos(phi1)), abs(math.cos(phi2))) < TINY:
        raise p.fail("lat_1 or lat_2 is out of range")
    if abs(phi1 - phi2) < TINY:
        n = math.sin(phi1)
    elif abs(phi1 + phi2) < TINY:
        raise p.fail("lat_1 and lat_2 are opposite")
    else:
        n = secant()
    if abs(n) < TINY or not math.isfinite(n):
        raise p.fail("the standard parallels give no cone")
    return n


def conic(p: Params, scale: float, n: float, rho_0: float, rho_of, lat_of) -> Op:
    """Points at distance rho(lat) from the apex, on rays at n times the longitude."""

    def fwd(m, lam, lat):
        rho, theta = m.let(rho_of(m, lat), n * lam)
        return scale * rho * m.sin(theta), scale * (rho_0 - rho * m.cos(theta))

    def inv(m, x, y):
        sign = math.copysign(1.0, n)
        u, v = m.let(sign / scale * x, sign * (rho_0 - y / scale))
        rho = m.let(sign * m.hypot(u, v))
        apex = m.let((rho <= 0) & (rho >= 0))
        return m.where(apex, 0.0, m.atan2(u, v) / n), m.where(apex, sign * HALF, lat_of(m, rho))

    return framed(p, fwd, inv)


def parallels(p: Params) -> tuple[float, float]:
    phi1 = p.angle("lat_1")
    return phi1, p.angle("lat_2") if "lat_2" in p and p.text("lat_2").lower() != "nan" else phi1


def albers(p: Params, phi0: float, phi1: float, phi2: float) -> Op:
    e = p.ellps()
    q = lambda v: float(e.qs(Np, math.sin(v)))
    m1, m2 = (float(e.msfn(Np, v)) for v in (phi1, phi2))
    n = cone(p, phi1, phi2, lambda: (m1 * m1 - m2 * m2) / (q(phi2) - q(phi1)))
    c = m1 * m1 + n * q(phi1)
    return conic(p, e.a, n, math.sqrt(c - n * q(phi0)) / n, lambda m, lat: m.sqrt(c - n * e.qs(m, m.sin(lat))) / n, lambda m, rho: authalic_inverse(m, e, (c - (rho * n) * (rho * n)) / n))


@operator("aea")
def aea(p: Params) -> Op:
    return albers(p, p.lat_0, *parallels(p))


@operator("leac")
def leac(p: Params) -> Op:
    return albers(p, p.lat_0, -HALF if p.flag("south") else HALF, p.angle("lat_1", 0.0))


@operator("eqdc")
def eqdc(p: Params) -> Op:
    e, (phi1, phi2) = p.ellps(), parallels(p)
    arc = lambda v: float(e.arc(Np, v)) / e.a
    m1, m2 = (float(e.msfn(Np, v)) for v in (phi1, phi2))
    n = cone(p, phi1, phi2, lambda: (m1 - m2) / (arc(phi2) - arc(phi1)))
    c = arc(phi1) + m1 / n
    return conic(p, e.a, n, c - arc(p.lat_0), lambda m, lat: c - e.arc(m, lat) / e.a, lambda m, rho: e.lat_of_arc(m, (c - rho) * e.a))


@operator("lcc")
def lcc(p: Params) -> Op:
    e, (phi1, phi2) = p.ellps(), parallels(p)
    phi0 = p.lat_0 if "lat_0" in p or "lat_2" in p else phi1
    ts = lambda v: float(e.ts(Np, v))
    m1, m2 = (float(e.msfn(Np, v)) for v in (phi1, phi2))
    n = cone(p, phi1, phi2, lambda: math.log(m1 / m2) / math.log(ts(phi1) / ts(phi2)), no_poles=True)
    c = m1 * ts(phi1) ** -n / n
    rho_0 = 0.0 if abs(abs(phi0) - HALF) < TINY else c * ts(phi0) ** n

    def rho(m, lat):
        polar = m.abs(m.abs(lat) - HALF) < TINY
        far = m.where(lat * n <= 0, math.nan, 0.0)
        return m.where(polar, far, c * m.power(e.ts(m, lat), n))

    return conic(p, e.a * p.k_0, n, rho_0, rho, lambda m, r: e.lat_of_ts(m, m.power(r / c, 1 / n)))


@operator("lcca")
def lcca(p: Params) -> Op:
    e, lat_0 = p.ellps(), p.angle("lat_0")
    if lat_0 == 0:
        raise p.fail("lat_0 isn't 0")
    n = math.sin(lat_0)
    w = 1 / (1 - e.es * n * n)
    c, r0, m0, k = 1 / (6 * w * w * (1 - e.es)), math.sqrt(w) / math.tan(lat_0), float(e.arc(Np, lat_0)) / e.a, e.a * p.k_0

    def fwd(m, lam, lat):
        s = m.let(e.arc(m, lat) / e.a - m0)
        r, theta = m.let(r0 - s * (1 + c * s * s), n * lam)
        return k * r * m.sin(theta), k * (r0 - r * m.cos(theta))

    def inv(m, x, y):
        x, y = m.let(x / k, y / k)
        theta = m.let(m.atan2(x, r0 - y))
        d = m.let(y - x * m.tan(theta / 2.0))
        s = d
        for _ in range(6):  # a cubic that is nearly straight
            s = m.let(s - (s * (1 + c * s * s) - d) / (1 + 3 * c * s * s))
        return theta / n, e.lat_of_arc(m, (s + m0) * e.a)

    return framed(p, fwd, inv, wrap=False)


@operator("lccnc")
def lccnc(p: Params) -> Op:
    """Near-conformal conic; the inverse is one step of Newton's method."""
    e, lat_0, k_0 = p.ellps(), p.angle("lat_0"), p.k_0
    if math.sin(lat_0) == 0:
        raise p.fail("lat_0 isn't 0")
    n, a = e.n, e.a
    nu, rho = float(e.prime_vertical(Np, lat_0)), float(e.meridian(Np, lat_0))
    cubic = 1 / (6 * nu * rho)
    # arc length by a series in the third flattening, per radian
    terms = (
        a * (1 - n + 5 / 4 * (n**2 - n**3) + 81 / 64 * (n**4 - n**5)),
        -3 / 2 * a * (n - n**2 + 7 / 8 * (n**3 - n**4) + 55 / 64 * n**5),
        15 / 16 * a * (n**2 - n**3 + 3 / 4 * (n**4 - n**5)),
        -35 / 48 * a * (n**3 - n**4 + 11 / 16 * n**5),
        315 / 512 * a * (n**4 - n**5),
    )

    def arc(m, lat):
        return terms[0] * lat + sum(v * m.sin(2 * i * lat) for i, v in enumerate(terms) if i)

    def slope(m, lat):
        # as the formulas are published: degrees in the first term
        return terms[0] + sum(2 * i * v * m.cos(2 * i * lat) for i, v in enumerate(terms) if i)

    s_0, r_0, turn = float(arc(Np, lat_0)), k_0 * nu / math.tan(lat_0), math.sin(lat_0)

    def fwd(m, lam, lat):
        d = m.let(arc(m, lat) - s_0)
        big = m.let(k_0 * (d + cubic * d * d * d))
        r, theta = r_0 - big, m.let(turn * lam)
        r = m.let(r)
        return r * m.sin(theta), big + r * m.sin(theta) * m.tan(theta / 2.0)

    def inv(m, x, y):
        big = m.let(r_0 - copysign(m, m.hypot(x, r_0 - y), lat_0))
        d = m.let(big - (big - k_0 * big - k_0 * cubic * big * big * big) / (-k_0 - 3 * k_0 * cubic * big * big))
        lat = m.let(lat_0 + d / terms[0])
        return m.atan2(x, r_0 - y) / turn, lat - (arc(m, lat) - d - s_0) / slope(m, lat)

    return framed(p, fwd, inv)


@operator("bonne")
def bonne(p: Params) -> Op:
    e, phi1 = p.ellps(), p.angle("lat_1")
    if abs(phi1) < TINY:
        raise p.fail("lat_1 isn't 0")
    round_ = e.spherical or p.flag("spherical")
    a = e.a
    if round_:
        e = Ellipsoid(a, 0.0)
    apex = 0.0 if abs(phi1) + TINY >= HALF else float(e.msfn(Np, phi1)) / math.sin(phi1)
    m1 = float(e.arc(Np, phi1)) / a

    def fwd(m, lam, lat):
        r = m.let(apex + m1 - e.arc(m, lat) / a)
        t = m.let(e.msfn(m, lat) * lam / r)
        near = m.let(m.abs(r) <= TINY)
        return m.where(near, 0.0, a * r * m.sin(t)), m.where(near, 0.0, a * (apex - r * m.cos(t)))

    def inv(m, x, y):
        u, v = m.let(x / a, apex - y / a)
        r = m.let(copysign(m, m.hypot(u, v), phi1))
        lat = m.let(e.lat_of_arc(m, a * (apex + m1 - r)))
        turn = m.atan2(u, v) if phi1 > 0 else m.atan2(-u, -v)
        far = m.let(m.abs(lat) - HALF)
        lam = m.where(m.abs(far) <= TINY, 0.0, r * turn / e.msfn(m, lat))
        return m.where(far > TINY, math.nan, lam), m.where(far > TINY, math.nan, lat)

    return framed(p, fwd, inv)


# -- azimuthal --------------------------------------------------------------------------------


def pole(lat_0: float) -> int:
    """1 or -1 at a pole, else 0."""
    return int(math.copysign(1, lat_0)) if abs(abs(lat_0) - HALF) < TINY else 0


def check(p: Params, key: str, value: float) -> float:
    if not abs(value) <= HALF + TINY:
        raise p.fail(f"{key} is out of range")
    return value


@operator("laea")
def laea(p: Params) -> Op:
    e, lat_0 = p.ellps(), check(p, "lat_0", p.lat_0)
    sign, qp, a = pole(lat_0), e.qp, e.a
    if sign:

        def fwd(m, lam, lat):
            q = qp - sign * e.qs(m, m.sin(lat))
            rho = m.let(a * m.sqrt(m.maximum(q, 0.0)))
            return rho * m.sin(lam), -sign * rho * m.cos(lam)

        def inv(m, x, y):
            rho = m.let(m.hypot(x, y) / a)
            return m.atan2(x, -sign * y), authalic_inverse(m, e, sign * (qp - rho * rho))

        return framed(p, fwd, inv)
    rq = math.sqrt(qp / 2)
    beta_0 = float(e.along(Np, e.authalic[0], lat_0))
    s0, c0 = math.sin(beta_0), math.cos(beta_0)
    d = float(e.msfn(Np, lat_0)) / (rq * c0)

    def forward(m, lam, lat):
        s = m.let(clamp(m, e.qs(m, m.sin(lat)) / qp, -1.0, 1.0))
        c = m.let(m.sqrt(1 - s * s))
        cl = m.let(m.cos(lam))
        far = m.let(1 + s0 * s + c0 * c * cl)
        k = m.let(m.where(far <= TINY, math.nan, a * rq * m.sqrt(2 / far)))
        return k * d * c * m.sin(lam), k / d * (c0 * s - s0 * c * cl)

    def back(m, x, y):
        x, y = m.let(x / (a * d), y * (d / a))
        rho = m.let(m.hypot(x, y))
        half = m.let(rho / (2 * rq))
        z = m.let(2 * m.asin(m.where(half > 1 + 1e-12, math.nan, m.minimum(half, 1.0))))
        sz, cz, near = m.let(m.sin(z), m.cos(z), rho < 1e-15)
        s = cz * s0 + y * sz * c0 / rho
        lat = e.along(m, e.authalic[1], m.asin(clamp(m, s, -1.0, 1.0)))
        return m.where(near, 0.0, m.atan2(x * sz, rho * c0 * cz - y * s0 * sz)), m.where(near, lat_0, lat)

    return framed(p, forward, back)


def stereographic(e: Ellipsoid, lat_0: float, lat_ts: float, k_0: float):
    sign = pole(lat_0)
    if sign:
        ts = abs(lat_ts)
        if abs(ts - HALF) < TINY:
            r = 2 * e.a * k_0 / math.sqrt((1 + e.e) ** (1 + e.e) * (1 - e.e) ** (1 - e.e))
        else:
            r = e.a * k_0 * float(e.msfn(Np, ts)) / float(e.ts(Np, ts))

        def fwd(m, lam, lat):
            v = m.let(sign * lat)
            rho = m.let(m.where(m.abs(v - HALF) < 1e-15, 0.0, r * e.ts(m, v)))
            return rho * m.sin(lam), -sign * rho * m.cos(lam)

        def inv(m, x, y):
            rho = m.let(m.hypot(x, y))
            near = m.let(rho < TINY)
            return m.where(near, 0.0, m.atan2(x, -sign * y)), m.where(near, lat_0, sign * e.lat_of_ts(m, rho / r))

        return fwd, inv
    chi_0 = float(e._chi(lat_0)) if not e.spherical else lat_0
    s0, c0 = math.sin(chi_0), math.cos(chi_0)
    r = 2 * e.a * k_0 * float(e.msfn(Np, lat_0)) / c0

    def forward(m, lam, lat):
        psi = m.let(e.isometric(m, lat))
        s, c, cl = m.let(m.tanh(psi), 1 / m.cosh(psi), m.cos(lam))
        far = m.let(1 + s0 * s + c0 * c * cl)
        k = m.let(m.where(far <= TINY, math.nan, r / far))
        return k * c * m.sin(lam), k * (c0 * s - s0 * c * cl)

    def back(m, x, y):
        rho = m.let(m.hypot(x, y))
        z = m.let(2 * m.atan(rho / r))
        sz, cz, near = m.let(m.sin(z), m.cos(z), rho < TINY)
        s = clamp(m, cz * s0 + y * sz * c0 / rho, -1.0, 1.0)
        lat = e.from_isometric(m, m.atanh(s))
        return m.where(near, 0.0, m.atan2(x * sz, rho * c0 * cz - y * s0 * sz)), m.where(near, lat_0, lat)

    return forward, back


@operator("stere")
def stere(p: Params) -> Op:
    lat_0 = check(p, "lat_0", p.lat_0)
    return framed(p, *stereographic(p.ellps(), lat_0, check(p, "lat_ts", p.angle("lat_ts") if "lat_ts" in p else lat_0), p.k_0))


@operator("ups")
def ups(p: Params) -> Op:
    lat_0 = -HALF if p.flag("south") else HALF
    fwd, inv = stereographic(p.ellps(), lat_0, lat_0, 0.994)

    def back(m, x, y):
        lam, lat = inv(m, *m.let(x - 2e6, y - 2e6))
        return wrapped(m, lam), lat

    return plane(lambda m, x, y: tuple(v + 2e6 for v in fwd(m, x, y)), back)


@operator("sterea")
def sterea(p: Params) -> Op:
    """Conformal to a sphere that fits at the origin, then stereographic."""
    e, lat_0 = p.ellps(), check(p, "lat_0", p.lat_0)
    c = math.sqrt(1 + e.second_es * math.cos(lat_0) ** 4)
    s0 = math.sin(lat_0) / c
    c0 = math.cos(math.asin(s0))
    k = math.atanh(s0) - c * float(e.isometric(Np, lat_0))
    r = 2 * e.a * p.k_0 * math.sqrt(1 - e.es) / (1 - e.es * math.sin(lat_0) ** 2)

    def fwd(m, lam, lat):
        psi, lam = m.let(c * e.isometric(m, lat) + k, c * lam)
        s, co, cl = m.let(m.tanh(psi), 1 / m.cosh(psi), m.cos(lam))
        far = m.let(r / (1 + s0 * s + c0 * co * cl))
        return far * co * m.sin(lam), far * (c0 * s - s0 * co * cl)

    def inv(m, x, y):
        rho = m.let(m.hypot(x, y))
        z = m.let(2 * m.atan(rho / r))
        sz, cz, near = m.let(m.sin(z), m.cos(z), rho <= 0)
        psi = m.atanh(cz * s0 + y * sz * c0 / rho)
        lat = e.from_isometric(m, (psi - k) / c)
        return m.where(near, 0.0, m.atan2(x * sz, rho * c0 * cz - y * s0 * sz) / c), m.where(near, lat_0, lat)

    return framed(p, fwd, inv)


@operator("aeqd")
def aeqd(p: Params) -> Op:
    e, lat_0 = p.ellps(), check(p, "lat_0", p.lat_0)
    sign = pole(lat_0)
    if sign:
        top = e.quadrant

        def fwd(m, lam, lat):
            rho = m.let(top - sign * e.arc(m, lat))
            rho = m.let(m.where(rho >= 2 * top - TINY, math.nan, rho))
            return rho * m.sin(lam), -sign * rho * m.cos(lam)

        def inv(m, x, y):
            rho = m.let(m.hypot(x, y))
            lat = sign * e.lat_of_arc(m, top - rho)
            return m.atan2(x, -sign * y), m.where(rho > 2 * top + TINY, math.nan, lat)

        return framed(p, fwd, inv)

    def forward(m, lam, lat):
        azimuth, _, s = geodesics.inverse(e, 0.0, lat_0, lam, lat)
        return s * m.sin(azimuth), s * m.cos(azimuth)

    def back(m, x, y):
        lam, lat, _ = geodesics.direct(e, 0.0, lat_0, m.atan2(x, y), m.hypot(x, y))
        return lam, lat

    return framed(p, forward, back, arrow=True)


@operator("guam_aeqd")
def guam_aeqd(p: Params) -> Op:
    e, lat_0 = p.ellps(default="clrk66"), p.lat_0
    m1 = float(e.arc(Np, lat_0))

    def fwd(m, lam, lat):
        x = m.let(lam * e.msfn(m, lat))
        return e.a * x, e.arc(m, lat) - m1 + 0.5 * e.a * lam * x * m.sin(lat)

    def inv(m, x, y):
        x = m.let(x / e.a)
        lat = lat_0
        for _ in range(3):
            s = m.sin(lat)
            lat = m.let(e.lat_of_arc(m, m1 + y - 0.5 * e.a * x * x * m.tan(lat) * m.sqrt(1 - e.es * s * s)))
        return x / e.msfn(m, lat), lat

    return framed(p, fwd, inv)


@operator("ortho")
def ortho(p: Params) -> Op:
    """Orthographic, on the ellipsoid a local view that may be turned by alpha and scaled."""
    e, lat_0 = p.ellps(), check(p, "lat_0", p.lat_0)
    s0, c0 = math.sin(lat_0), math.cos(lat_0)
    turn, k = p.angle("alpha", 0.0), p.k_0
    ca, sa = math.cos(turn), math.sin(turn)
    nu0 = 1 / math.sqrt(1 - e.es * s0 * s0)

    def unit(m, lam, lat):
        s, c, cl = m.let(m.sin(lat), m.cos(lat), m.cos(lam))
        nu = m.let(1 / m.sqrt(1 - e.es * s * s))
        x = nu * c * m.sin(lam)
        y = nu * (s * c0 - c * s0 * cl) + e.es * (nu0 * s0 - nu * s) * c0
        behind = m.let(s0 * s + c0 * c * cl < -TINY)
        return m.where(behind, math.nan, x), m.where(behind, math.nan, y)

    def fwd(m, lam, lat):
        x, y = m.let(*unit(m, lam, lat))
        return e.a * k * (x * ca - y * sa), e.a * k * (x * sa + y * ca)

    def inv(m, x, y):
        x, y = m.let((ca * x + sa * y) / (e.a * k), (ca * y - sa * x) / (e.a * k))
        # the outline of the ellipsoid, then the sphere under it as a first guess
        shift, squeeze = e.es * nu0 * s0 * c0, math.sqrt(1 - e.es * c0 * c0)
        v = m.let((y - shift) * (1 / squeeze) if not e.spherical else y)
        rho = m.let(m.hypot(x, v))
        rim = m.let(m.where(rho > 1 + 1e-10, math.nan, m.minimum(rho, 1.0)))
        cz = m.let(m.sqrt(1 - rim * rim))
        near = m.let(rho <= TINY)
        lat = m.where(near, lat_0, m.asin(clamp(m, cz * s0 + v * c0 * rim / rho, -1.0, 1.0)))
        lam = m.where(near, 0.0, m.atan2(x * rim, rho * c0 * cz - v * s0 * rim))
        if e.spherical:
            return lam, lat
        shrink = 1 - 1e-9  # a guess on the rim has no slope
        return invert(lambda a, b: ortho_free(a, b), x, y, lam, lat * shrink)

    def ortho_free(lam, lat):
        m = Np
        s, c, cl = m.sin(lat), m.cos(lat), m.cos(lam)
        nu = 1 / m.sqrt(1 - e.es * s * s)
        return nu * c * m.sin(lam), nu * (s * c0 - c * s0 * cl) + e.es * (nu0 * s0 - nu * s) * c0

    op = framed(p, fwd, inv)
    return Op(op.fwd, op.inv, arrow=not e.spherical)


@operator("geos")
def geos(p: Params) -> Op:
    e = p.ellps()
    h, sweep = p.real("h") / e.a, p.text("sweep", "y")
    if not 0 < h <= 1e10 or sweep not in "xy":
        raise p.fail("h is positive, sweep is x or y")
    flip, far, ratio2 = sweep == "x", 1 + h, 1 - e.es
    ratio = math.sqrt(ratio2)

    def fwd(m, lam, lat):
        gc = m.let(m.atan(ratio2 * m.tan(lat)))
        s, c = m.let(m.sin(gc), m.cos(gc))
        r = m.let(ratio / m.hypot(ratio * c, s))
        vx, vy, vz = m.let(r * m.cos(lam) * c, r * m.sin(lam) * c, r * s)
        hidden = m.let((far - vx) * vx - vy * vy - vz * vz * (1 / ratio2) < 0)
        d = m.let(m.where(hidden, math.nan, far - vx)) if not e.spherical else far - vx
        if flip:
            return e.a * h * m.atan(vy / m.hypot(vz, d)), e.a * h * m.atan(vz / d)
        return e.a * h * m.atan(vy / d), e.a * h * m.atan(vz / m.hypot(vy, d))

    def inv(m, x, y):
        tx, ty = m.let(m.tan(x / (e.a * h)), m.tan(y / (e.a * h)))
        vy, vz = m.let(*((tx * m.sqrt(1 + ty * ty), ty) if flip else (tx, ty * m.sqrt(1 + tx * tx))))
        a = m.let(vy * vy + vz * vz / ratio2 + 1)
        det = m.let(far * far - a * (far * far - 1))
        k = m.let((far - m.sqrt(m.where(det < 0, math.nan, det))) / a)
        vx, vy, vz = m.let(far - k, vy * k, vz * k)
        return m.atan2(vy, vx), m.atan(vz / ratio2 / m.hypot(vx, vy))

    return framed(p, fwd, inv, wrap=False)


@operator("tpeqd")
def tpeqd(p: Params) -> Op:
    """Distances from two points are true, on the sphere; longitudes count from the middle of the points'. On the map
    a place is the third corner of a plane triangle with its two great-circle distances as sides; back, it is the third
    corner of a spherical one."""
    a = p.ellps().a
    (f1, l1), (f2, l2) = ((p.angle(f"lat_{k}"), p.angle(f"lon_{k}", 0.0)) for k in (1, 2))
    half = float(wrapped(Np, l2 - l1)) / 2
    place = lambda lat, lon: np.array([math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)])
    one, two = place(f1, -half), place(f2, half)
    pole = np.cross(one, two)
    base = math.atan2(float(np.linalg.norm(pole)), float(one @ two))
    if base < 1e-12 or base > math.pi - 1e-12:
        raise p.fail("the two points are distinct and not antipodes")
    pole = pole / np.linalg.norm(pole)
    ahead = np.cross(pole, one)  # from the first point towards the second
    x_0, y_0 = p.x_0, p.y_0
    dot = lambda u, v: u[0] * float(v[0]) + u[1] * float(v[1]) + u[2] * float(v[2])

    def fwd(m, lon, lat):
        c = m.let(m.cos(lat))
        v = m.let(c * m.cos(lon), c * m.sin(lon), m.sin(lat))
        aside = m.let(dot(v, pole))

        def away(point):
            # across and along the great circle of both points
            return m.atan2(m.hypot(aside, dot(v, np.cross(pole, point))), dot(v, point))

        d1, d2 = m.let(away(one), away(two))
        x = m.let((d1 - d2) * (d1 + d2) / (2 * base))
        y = m.sqrt(m.maximum(d1 * d1 - (x + base / 2) * (x + base / 2), 0.0))
        return a * x + x_0, a * m.where(aside < 0, -y, y) + y_0

    def inv(m, x, y):
        x, y = m.let((x - x_0) / a, (y - y_0) / a)
        d1 = m.let(m.hypot(x + base / 2, y))
        c1, s1 = m.let(m.cos(d1), m.sin(d1))
        along = m.let((m.cos(m.hypot(x - base / 2, y)) - c1 * math.cos(base)) / math.sin(base))
        across = m.let(m.sqrt(m.maximum(s1 * s1 - along * along, 0.0)))
        across = m.let(m.where(y < 0, -across, across))
        u, v, w = m.let(*(c1 * float(one[k]) + along * float(ahead[k]) + across * float(pole[k]) for k in range(3)))
        return m.atan2(v, u), m.atan2(w, m.hypot(u, v))

    return plane(fwd, inv)


# -- Krovak -----------------------------------------------------------------------------------

#: Pole of the oblique cone, its standard parallel, and the polynomial of the modified form.
POLE, PARALLEL = 1.04216856380474, 1.37008346281555
MODIFIED = (2.946529277e-02, 2.515965696e-02, 1.193845912e-07, -4.668270147e-07, 9.233980362e-12, 1.523735715e-12, 1.696780024e-18, 4.408314235e-18, -8.331083518e-24, -3.689471323e-24)


def _krovak(p: Params, modified: bool) -> Op:
    e = Ellipsoid.named("bessel")
    lat_0, lon_0 = p.angle("lat_0", 49.5), p.angle("lon_0", 24 + 50 / 60)
    alpha = math.sqrt(1 + e.second_es * math.cos(lat_0) ** 4)
    k = math.atanh(math.sin(lat_0) / alpha) - alpha * float(e.isometric(Np, lat_0))
    n = math.sin(PARALLEL)
    rho_0 = p.real("k", 0.9999) * e.a * math.sqrt(1 - e.es) / (1 - e.es * math.sin(lat_0) ** 2) / math.tan(PARALLEL)
    s_pole, c_pole = math.sin(HALF - POLE), math.cos(HALF - POLE)
    west = p.text("axis", "enu").lower() == "swu"
    x_0, y_0 = p.x_0, p.y_0

    def bend(m, s, w):
        """The correction, a complex polynomial of degree four."""
        c = MODIFIED
        x, y = m.let(s - 1089000.0, w - 654000.0)
        x2, y2 = m.let(x * x, y * y)
        r3, i3, r4, i4 = m.let(x * (x2 - 3 * y2), y * (3 * x2 - y2), x2 * x2 + y2 * y2 - 6 * x2 * y2, 4 * x * y * (x2 - y2))
        dx = c[0] + c[2] * x - c[3] * y - 2 * c[5] * x * y + c[4] * (x2 - y2) + c[6] * r3 - c[7] * i3 + c[8] * i4 + c[9] * r4
        dy = c[1] + c[2] * y + c[3] * x + 2 * c[4] * x * y + c[5] * (x2 - y2) + c[7] * r3 + c[6] * i3 - c[9] * i4 + c[8] * r4
        return dx, dy

    def fwd(m, lon, lat):
        lam, u = m.let(-alpha * (lon - lon_0), m.atan(m.sinh(alpha * e.isometric(m, lat) + k)))
        s = m.let(m.asin(c_pole * m.sin(u) + s_pole * m.cos(u) * m.cos(lam)))
        d = m.asin(m.cos(u) * m.sin(lam) / m.cos(s))
        rho = m.let(rho_0 * m.power(math.tan(PARALLEL / 2 + QUARTER) / m.tan(s / 2.0 + QUARTER), n))
        eps = m.let(n * d)
        south, westing = m.let(rho * m.cos(eps), rho * m.sin(eps))
        if modified:
            dx, dy = bend(m, south, westing)
            south, westing = m.let(south - dx, westing - dy)
        return (south + y_0, westing + x_0) if west else (-westing - x_0, -south - y_0)

    def inv(m, x, y):
        westing, south = m.let(*((y - x_0, x - y_0) if west else (-x - x_0, -y - y_0)))
        if modified:
            dx, dy = bend(m, south, westing)
            south, westing = m.let(south + dx, westing + dy)
        rho, d = m.let(m.hypot(south, westing), m.atan2(westing, south) / n)
        s = 2 * m.atan(m.power(rho_0 / rho, 1 / n) * math.tan(PARALLEL / 2 + QUARTER)) - HALF
        s = m.let(m.where(rho <= 0, HALF, s))
        u = m.let(m.asin(c_pole * m.sin(s) - s_pole * m.cos(s) * m.cos(d)))
        lam = m.asin(m.cos(s) * m.sin(d) / m.cos(u))
        return lon_0 - lam / alpha, e.from_isometric(m, (m.asinh(m.tan(u)) - k) / alpha)

    return plane(fwd, inv)


operator("krovak")(lambda p: _krovak(p, False))
operator("mod_krovak")(lambda p: _krovak(p, True))



@operator("poly")
def poly(p: Params) -> Op:
    """American polyconic."""
    e = p.ellps()
    ml0 = float(e.arc(Np, p.lat_0)) / e.a
    a = e.a

    def unit(m, lam, lat):
        s = m.let(m.sin(lat))
        el = m.let(lam * s)
        flat = m.let(m.abs(lat) <= TINY)
        ms = m.let(e.msfn(m, lat) / m.where(flat, 1.0, s))
        ml = e.arc(m, lat) / e.a
        return m.where(flat, lam, ms * m.sin(el)), m.where(flat, -ml0, ml - ml0 + ms * (1 - m.cos(el)))

    def fwd(m, lam, lat):
        x, y = unit(m, lam, lat)
        return a * x, a * y

    def inv(m, x, y):
        x, y = x / a, y / a
        c = y + ml0
        # on the sphere the latitude has an equation of its own; its solution is the first guess
        f = lambda v: c - v - 0.5 * (v * v - 2 * c * v + x * x + c * c) * m.tan(v)
        guess = root(f, c * 0.999)
        guess = m.where(m.isnan(guess) | (m.abs(guess) > HALF), c * 0.9, guess)
        s = m.where(m.abs(m.sin(guess)) < 1e-6, 1e-6, m.sin(guess))
        lam = m.asin(clamp(m, x * m.tan(guess), -1.0, 1.0)) / s
        lam = m.where(m.abs(guess) < 1e-5, x, lam)
        return invert(lambda u, v: unit(Np, u, v), x, y, lam, guess)

    op = framed(p, fwd, inv, wrap=False)
    return Op(op.fwd, op.inv, arrow=True)
