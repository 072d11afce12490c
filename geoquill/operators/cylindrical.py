"""Cylindrical projections, normal, transverse and oblique."""

from __future__ import annotations

import math

from ..functions.ellipsoid import Ellipsoid
from ..functions.mathx import Np, clamp, complex_sine_parts, complex_sine_series, sine_series, wrapped
from ..plans.parameters import Params
from ..plans.registry import Op, framed, operator, plane
from .solve import invert

HALF, QUARTER = math.pi / 2, math.pi / 4


@operator("merc")
def merc(p: Params) -> Op:
    e = p.ellps()
    k = float(e.msfn(Np, p.angle("lat_ts"))) if "lat_ts" in p else p.k_0
    r = k * e.a
    return framed(p, lambda m, lam, lat: (r * lam, r * e.isometric(m, lat)), lambda m, x, y: (x / r, e.from_isometric(m, y / r)))


@operator("webmerc")
def webmerc(p: Params) -> Op:
    a = 6378137.0
    return framed(p, lambda m, lam, lat: (a * lam, a * m.log(m.tan(QUARTER + lat / 2.0))), lambda m, x, y: (x / a, HALF - 2 * m.atan(m.exp(-y / a))))


@operator("mill")
def mill(p: Params) -> Op:
    a = p.ellps().a
    return framed(p, lambda m, lam, lat: (a * lam, 1.25 * a * m.log(m.tan(QUARTER + 0.4 * lat))), lambda m, x, y: (x / a, 2.5 * (m.atan(m.exp(0.8 / a * y)) - QUARTER)))


@operator("eqc")
def eqc(p: Params) -> Op:
    e, ts = p.ellps(), p.angle("lat_ts", 0.0)
    if not abs(ts) < HALF:
        raise p.fail("|lat_ts| is 90 degrees at most")
    r, m0 = e.a * float(e.msfn(Np, ts)), float(e.arc(Np, p.lat_0))
    return framed(p, lambda m, lam, lat: (r * lam, e.arc(m, lat) - m0), lambda m, x, y: (x / r, e.lat_of_arc(m, y + m0)), wrap=False)


@operator("cea")
def cea(p: Params) -> Op:
    e = p.ellps()
    if "lat_ts" in p and ("k_0" in p or "k" in p):
        raise p.fail("lat_ts and k_0 exclude each other")
    ts = p.angle("lat_ts", 0.0)
    if abs(ts) > HALF:
        raise p.fail("|lat_ts| is 90 degrees at most")
    k = float(e.msfn(Np, ts)) if "lat_ts" in p else p.k_0

    def inv(m, x, y):
        return x / (e.a * k), authalic_inverse(m, e, 2 * k / e.a * y)

    return framed(p, lambda m, lam, lat: (e.a * k * lam, e.a / k / 2 * e.qs(m, m.sin(lat))), inv)


def authalic_inverse(m, e: Ellipsoid, q):
    """Latitude from q; NaN beyond the poles."""
    s = m.let(q / e.qp)
    s = m.where(m.abs(s) > 1 + 1e-10, math.nan, clamp(m, s, -1.0, 1.0))
    return e.along(m, e.authalic[1], m.asin(s))


# -- transverse Mercator ----------------------------------------------------------------------


def transverse(e: Ellipsoid, k_0: float, lat_0: float):
    """Forward and inverse of the sixth-order series, metres from the origin."""
    q = k_0 * e.rectifying_radius
    z = float(e.along(Np, e.conformal[0], lat_0))
    zero = q * (z + float(sine_series(Np, e.mercator[0], 2 * z)))

    def fwd(m, lam, lat):
        chi = m.let(e.along(m, e.conformal[0], lat))
        s, c, sl, cl = m.let(m.sin(chi), m.cos(chi), m.sin(lam), m.cos(lam))
        ccl = m.let(c * cl)
        size = m.let(1 / m.hypot(s, ccl))
        tan_lon = m.let(sl * c * size)
        north, east = m.atan2(s, ccl), m.asinh(tan_lon)
        # functions of the doubled angles without further trigonometry
        f = m.let(2 * size * size)
        dn, de = complex_sine_parts(m, e.mercator[0], s * ccl * f, ccl * ccl * f - 1, 2 * tan_lon * size, f - 1)
        return q * (east + de), q * (north + dn) - zero

    def inv(m, x, y):
        north, east = m.let((y + zero) / q, x / q)
        dn, de = complex_sine_series(m, e.mercator[1], 2 * north, 2 * east)
        n, g = m.let(north + dn, m.atan(m.sinh(east + de)))
        s, c, sl, cl = m.let(m.sin(n), m.cos(n), m.sin(g), m.cos(g))
        ccl = c * cl
        return m.atan2(sl, ccl), e.along(m, e.conformal[1], m.atan2(s * cl, m.hypot(sl, ccl)))

    return fwd, inv


@operator("tmerc", "etmerc")
def tmerc(p: Params) -> Op:
    return framed(p, *transverse(p.ellps(), p.k_0, p.lat_0), wrap=False)


def _zone(p: Params) -> tuple[float, float]:
    zone = p.natural("zone")
    if not 1 <= zone <= 60:
        raise p.fail("zone is 1 to 60")
    return math.radians(6 * zone - 183), 10_000_000.0 if p.flag("south") else 0.0


def _shifted(fwd, inv, lon_0: float, x_0: float, y_0: float) -> Op:
    def forward(m, x, y):
        a, b = fwd(m, m.let(x - lon_0), y)
        return a + x_0, b + y_0

    def back(m, x, y):
        lam, lat = inv(m, *m.let(x - x_0, y - y_0))
        return lam + lon_0, lat

    return plane(forward, back)


@operator("utm")
def utm(p: Params) -> Op:
    e = p.ellps()
    if e.spherical:
        raise p.fail("an ellipsoid is needed")
    lon_0, y_0 = _zone(p)
    return _shifted(*transverse(e, 0.9996, 0.0), lon_0, 500_000.0, y_0)


def _bowring(e: Ellipsoid, k_0: float, lat_0: float):
    """The older series of low order."""
    eps = e.second_es

    def fwd(m, lam, lat):
        lat = m.let(lat + lat_0)
        s, c, oo = m.let(m.sin(lat), m.cos(lat), lam * lam)
        cc, half, n = m.let(c * c, m.sin(lam / 2.0), e.prime_vertical(m, lat))
        z = m.let(eps / 6 * lam * oo * c * cc * cc)
        theta = m.atan2(2 * s * c * half * half, s * s + cc * m.cos(lam))
        x = k_0 * n * (m.atanh(c * m.sin(lam)) + z * (1 + oo * (36 * cc - 29) / 10.0))
        return x, k_0 * (e.arc(m, lat) + n * theta + z * n * lam * s / 4.0 * (9 + 4 * eps * cc + oo * (20 * cc - 11)))

    def inv(m, x, y):
        lat = m.let(e.lat_of_arc(m, y / k_0))
        s, c = m.let(m.sin(lat), m.cos(lat))
        cc, t = m.let(c * c, s / c)
        x = m.let(x / (k_0 * e.prime_vertical(m, lat)))
        xx = m.let(x * x)
        theta = m.let(m.atan2(m.sinh(x), c))
        north = m.atan(t * m.cos(theta)) - xx * xx * eps / 24 * t * (9 - 10 * cc)
        lam = theta - eps / 60 * xx * x * c * (10 - 4 * xx / cc + xx * cc)
        return lam, lat_0 + (1 + cc * eps) * north - eps * cc * lat

    return fwd, inv


@operator("btmerc")
def btmerc(p: Params) -> Op:
    return framed(p, *_bowring(p.ellps(), p.k_0, p.lat_0), wrap=False)


@operator("butm")
def butm(p: Params) -> Op:
    lon_0, y_0 = _zone(p)
    return _shifted(*_bowring(p.ellps(), 0.9996, 0.0), lon_0, 500_000.0, y_0)


@operator("tmgrid")
def tmgrid(p: Params) -> Op:
    """Transverse Mercator in the zone of each point; eastings begin with the zone's number."""
    first, width = p.angle("lon_i"), p.real("zone_width")
    if width <= 0:
        raise p.fail("zone_width is positive")
    zones, width = round(360 / width), math.radians(width)
    fwd, inv = transverse(p.ellps(), p.k_0, p.lat_0)
    x_0, y_0 = p.x_0, p.y_0
    middle = lambda zone: first - width / 2 + zone * width

    def forward(m, lon, lat):
        turn = m.let(m.floor((lon - first) / width + 1e-12))
        zone = m.let(turn - zones * m.floor(turn / float(zones)) + 1)
        x, y = fwd(m, m.let(lon - middle(zone)), lat)
        return x + x_0 + zone * 1e6, y + y_0

    def back(m, x, y):
        zone = m.let(clamp(m, m.floor(x / 1e6), 1.0, float(zones)))
        lam, lat = inv(m, *m.let(x - x_0 - zone * 1e6, y - y_0))
        return wrapped(m, lam + middle(zone)), lat

    return plane(forward, back)


@operator("gstmerc")
def gstmerc(p: Params) -> Op:
    """Gauss-Schreiber: conformal to a sphere, then transverse."""
    e, lat_0 = p.ellps(), p.lat_0
    n1 = math.sqrt(1 + e.second_es * math.cos(lat_0) ** 4)
    phic = math.asin(math.sin(lat_0) / n1)
    c = math.asinh(math.tan(phic)) - n1 * float(e.isometric(Np, lat_0))
    n2 = p.k_0 * e.a * math.sqrt(1 - e.es) / (1 - e.es * math.sin(lat_0) ** 2)

    def fwd(m, lam, lat):
        lam, psi = m.let(n1 * lam, c + n1 * e.isometric(m, lat))
        return n2 * m.atanh(m.sin(lam) / m.cosh(psi)), n2 * (m.atan(m.sinh(psi) / m.cos(lam)) - phic)

    def inv(m, x, y):
        u, v = m.let(x / n2, y / n2 + phic)
        psi = m.atanh(m.sin(v) / m.cosh(u))
        return m.atan(m.sinh(u) / m.cos(v)) / n1, e.from_isometric(m, (psi - c) / n1)

    return framed(p, fwd, inv, wrap=False)


@operator("tcea")
def tcea(p: Params) -> Op:
    a, k, lat_0 = p.ellps().a, p.k_0, p.lat_0

    def inv(m, x, y):
        x, y = m.let(x * (k / a), y / (a * k) + lat_0)
        t = m.let(m.sqrt(1 - x * x))
        return m.atan2(x, t * m.cos(y)), m.asin(t * m.sin(y))

    return framed(p, lambda m, lam, lat: (a / k * m.cos(lat) * m.sin(lam), a * k * (m.atan2(m.tan(lat), m.cos(lam)) - lat_0)), inv, wrap=False)


@operator("ocea")
def ocea(p: Params) -> Op:
    a, k, lat_0 = p.ellps().a, p.k_0, p.lat_0
    if "alpha" in p:
        alpha = math.pi + p.angle("alpha")
        lam_p = math.atan2(-math.cos(alpha), -math.sin(lat_0) * math.sin(alpha)) + p.angle("lonc", 0.0)
        phi_p = math.asin(math.cos(lat_0) * math.sin(alpha))
    else:
        f1, f2, l1, l2 = p.angle("lat_1"), p.angle("lat_2"), p.angle("lon_1", 0.0), p.angle("lon_2", 0.0)
        u, v = math.cos(f1) * math.sin(f2), math.sin(f1) * math.cos(f2)
        lam_p = math.atan2(u * math.cos(l1) - v * math.cos(l2), v * math.sin(l2) - u * math.sin(l1))
        if abs(l1 + HALF) < 1e-15:
            lam_p = -lam_p
        side = math.cos(lam_p - l1)
        phi_p = math.atan(-side / math.tan(f1)) if math.tan(f1) else -math.copysign(HALF, side)
    s_p, c_p = math.sin(phi_p), math.cos(phi_p)

    def fwd(m, lam, lat):
        sl, cl = m.let(m.sin(lam), m.cos(lam))
        x = m.atan((m.tan(lat) * c_p + s_p * sl) / cl)
        return a * k * m.where(cl < 0, x + math.pi, x), a / k * (s_p * m.sin(lat) - c_p * m.cos(lat) * sl)

    def inv(m, x, y):
        x, y = m.let(x / (a * k), y * (k / a))
        t, s = m.let(m.sqrt(1 - y * y), m.sin(x))
        return m.atan2(t * s_p * s - y * c_p, t * m.cos(x)), m.asin(y * s_p + t * c_p * s)

    return framed(p, fwd, inv, wrap=False, lon_0=lam_p + HALF)


@operator("cass")
def cass(p: Params) -> Op:
    e, lat_0, bent = p.ellps(), p.lat_0, p.flag("hyperbolic")
    if e.spherical:

        def fwd(m, lam, lat):
            return e.a * m.asin(m.cos(lat) * m.sin(lam)), e.a * (m.atan2(m.tan(lat), m.cos(lam)) - lat_0)

        def inv(m, x, y):
            d, x = m.let(y / e.a + lat_0, x / e.a)
            return m.atan2(m.tan(x), m.cos(d)), m.asin(m.sin(d) * m.cos(x))

        return framed(p, fwd, inv)
    m0 = float(e.arc(Np, lat_0)) / e.a

    def unit(m, lam, lat):
        s, c = m.let(m.sin(lat), m.cos(lat))
        nu2 = m.let(1 / (1 - e.es * s * s))
        nu, t, cc = m.let(m.sqrt(nu2), (s / c) * (s / c), e.second_es * c * c)
        a1 = m.let(lam * c)
        a2 = m.let(a1 * a1)
        x = nu * a1 * (1 - a2 * t * (1 / 6 + (8 - t + 8 * cc) * a2 / 120.0))
        y = m.let(e.arc(m, lat) / e.a - m0 + nu * (s / c) * a2 * (0.5 + (5 - t + 6 * cc) * a2 / 24.0))
        return x, y - y * y * y / (6 * (1 - e.es) * nu2 * nu2) if bent else y

    def fwd(m, lam, lat):
        x, y = unit(m, lam, lat)
        return e.a * x, e.a * y

    def inv(m, x, y):
        x, y = x / e.a, y / e.a
        foot = e.lat_of_arc(m, e.a * (m0 + y))
        return invert(lambda a, b: unit(Np, a, b), x, y, x / m.cos(foot), foot)

    op = framed(p, fwd, inv)
    return Op(op.fwd, op.inv, arrow=True)


@operator("somerc")
def somerc(p: Params) -> Op:
    """Swiss oblique Mercator: conformal to a sphere, turned, then Mercator."""
    e, lat_0 = p.ellps(), p.lat_0
    c = math.sqrt(1 + e.second_es * math.cos(lat_0) ** 4)
    s0 = math.sin(lat_0) / c
    c0 = math.cos(math.asin(s0))
    k = math.atanh(s0) - c * float(e.isometric(Np, lat_0))
    r = p.k_0 * e.a * math.sqrt(1 - e.es) / (1 - e.es * math.sin(lat_0) ** 2)

    def fwd(m, lam, lat):
        phi, lam = m.let(m.atan(m.sinh(c * e.isometric(m, lat) + k)), c * lam)
        s, co = m.let(m.sin(phi), m.cos(phi))
        turned = m.let(m.asin(c0 * s - s0 * co * m.cos(lam)))
        return r * m.asin(co * m.sin(lam) / m.cos(turned)), r * m.asinh(m.tan(turned))

    def inv(m, x, y):
        phi, lam = m.let(m.atan(m.sinh(y / r)), x / r)
        s, co = m.let(m.sin(phi), m.cos(phi))
        sphere = m.let(m.asin(c0 * s + s0 * co * m.cos(lam)))
        return m.asin(co * m.sin(lam) / m.cos(sphere)) / c, e.from_isometric(m, (m.asinh(m.tan(sphere)) - k) / c)

    return framed(p, fwd, inv, wrap=False)


@operator("omerc")
def omerc(p: Params) -> Op:
    """Hotine oblique Mercator by a central point and azimuth, or by two points."""
    e, k0 = p.ellps(), p.k_0
    latc = p.angle("latc") if "latc" in p else p.lat_0
    lonc = p.angle("lonc") if "lonc" in p else p.lon_0
    central = "alpha" in p or "gamma_c" in p
    if abs(latc) >= HALF - 1e-7:
        raise p.fail("the centre is no pole")
    s, c = math.sin(latc), math.cos(latc)
    b = math.sqrt(1 + e.second_es * c**4)
    a = e.a * b * k0 * math.sqrt(1 - e.es) / (1 - e.es * s * s)
    d = max(1.0, b * math.sqrt(1 - e.es) / (c * math.sqrt(1 - e.es * s * s)))
    f = d + math.sqrt(d * d - 1) * (math.copysign(1, latc) if latc else 0)
    big = f * float(e.ts(Np, latc)) ** b
    clip = lambda v: math.asin(max(-1.0, min(1.0, v)))
    if central:
        if "alpha" in p:
            alpha = p.angle("alpha")
            gamma_0 = clip(math.sin(alpha) / d)
            gamma_c = p.angle("gamma_c") if "gamma_c" in p else alpha
        else:
            gamma_0 = gamma_c = p.angle("gamma_c")
            if abs(d * math.sin(gamma_0)) > 1:
                raise p.fail("gamma_c is out of range")
            alpha = math.asin(d * math.sin(gamma_0))
        lam_0 = lonc - clip((f - 1 / f) / 2 * math.tan(gamma_0)) / b
        offset = not p.flag("no_off") or ("alpha" in p and "gamma_c" not in p)
    else:
        f1, f2, l1, l2 = p.angle("lat_1"), p.angle("lat_2"), p.angle("lon_1", 0.0), p.angle("lon_2", 0.0)
        if max(abs(f1), abs(f2)) > HALF - 1e-7 or abs(f1 - f2) <= 1e-7 or abs(f1) <= 1e-7:
            raise p.fail("lat_1 and lat_2 differ, are no poles, and lat_1 isn't 0")
        h, l = (float(e.ts(Np, v)) ** b for v in (f1, f2))  # noqa: E741
        l2 -= 2 * math.pi * round((l2 - l1) / (2 * math.pi))
        j = (big * big - l * h) / (big * big + l * h)
        lam_0 = float(wrapped(Np, 0.5 * (l1 + l2) - math.atan(j * math.tan(0.5 * b * (l1 - l2)) * (l + h) / (l - h)) / b))
        gamma_0 = math.atan(2 * math.sin(b * float(wrapped(Np, l1 - lam_0))) / (big / h - h / big))
        alpha = gamma_c = clip(d * math.sin(gamma_0))
        offset = not p.flag("no_off")
    u_0 = math.copysign(abs(a / b * math.atan(math.sqrt(d * d - 1) / math.cos(alpha))), latc) if offset else 0.0
    s0, c0, sr, cr, turned = math.sin(gamma_0), math.cos(gamma_0), math.sin(gamma_c), math.cos(gamma_c), not p.flag("no_rot")
    straight = offset and central and abs(abs(alpha) - HALF) <= 1e-10

    def fwd(m, lon, lat):
        lam, psi = m.let(b * wrapped(m, lon - lam_0), b * e.isometric(m, lat) + math.log(big))
        # W = exp(psi): half difference and half sum are its hyperbolic sine and cosine
        sh, ch, sl, cl = m.let(m.sinh(psi), m.cosh(psi), m.sin(lam), m.cos(lam))
        polar = m.let(m.abs(m.abs(lat) - HALF) <= 1e-10)
        v = m.let(m.where(polar, a / b * m.log(m.tan(QUARTER - m.sign(lat) * (gamma_0 / 2))), -a / b * m.atanh((sh * s0 - sl * c0) / ch)))
        u = m.where(m.abs(cl) < 1e-7, a / b * lam, a / b * m.atan2(sh * c0 + sl * s0, cl))
        u = m.where(polar, a / b * lat, u)
        if straight:
            u = m.where(lam == 0 if not hasattr(lam, "s") else (lam <= 0) & (lam >= 0), 0.0, u)
        if not turned:
            return u, v
        u = m.let(u - u_0)
        return v * cr + u * sr, u * cr - v * sr

    def inv(m, x, y):
        u, v = m.let(y * cr + x * sr + u_0, x * cr - y * sr) if turned else (x, y)
        q, w = m.let(-b / a * v, b / a * u)
        sh, ch, sw = m.let(m.sinh(q), m.cosh(q), m.sin(w))
        up = m.let((sw * c0 + sh * s0) / ch)
        polar = m.let(m.abs(m.abs(up) - 1) < 1e-10)
        lat = e.from_isometric(m, (m.atanh(up) - math.log(big)) / b)
        lon = lam_0 - m.atan2(sh * c0 - sw * s0, m.cos(w)) / b
        return m.where(polar, lam_0, lon), m.where(polar, m.sign(up) * HALF, lat)

    x_0, y_0 = p.x_0, p.y_0
    return plane(lambda m, x, y: tuple(v + o for v, o in zip(fwd(m, x, y), (x_0, y_0), strict=True)), lambda m, x, y: inv(m, *m.let(x - x_0, y - y_0)))
