"""Pseudocylindrical projections, and the quadrilateralised sphere."""

from __future__ import annotations

import math

from ..functions.mathx import clamp
from ..plans.parameters import Params
from ..plans.registry import Op, framed, operator, plane
from .cylindrical import authalic_inverse

HALF, QUARTER = math.pi / 2, math.pi / 4


@operator("sinu")
def sinu(p: Params) -> Op:
    e = p.ellps()

    def fwd(m, lam, lat):
        return e.a * lam * e.msfn(m, lat), e.arc(m, lat)

    def inv(m, x, y):
        lat = m.let(e.lat_of_arc(m, y))
        past = m.let(m.abs(lat) - HALF)
        lam = m.where(m.abs(past) <= 1e-10, 0.0, x / e.a / e.msfn(m, lat))
        return m.where(past > 1e-10, math.nan, lam), m.where(past > 1e-10, math.nan, lat)

    return framed(p, fwd, inv)


@operator("moll")
def moll(p: Params) -> Op:
    a = p.ellps().a
    cx, cy = 2 * math.sqrt(2) / math.pi, math.sqrt(2)

    def fwd(m, lam, lat):
        # theta + sin(theta) = pi sin(lat), by Newton from a guess that is good near the pole as well
        k = m.let(math.pi * m.sin(lat))
        near = HALF - m.abs(lat)
        guess = math.pi - m.power(m.maximum(12 * math.pi / 2 * near * near, 0.0), 1 / 3)
        theta = m.let(m.where(near < 0.35, m.sign(lat) * guess, lat))
        for _ in range(7):
            d = m.let(1 + m.cos(theta))
            theta = m.let(m.where(d < 1e-12, theta, theta - (theta + m.sin(theta) - k) / m.where(d < 1e-12, 1.0, d)))
        return a * cx * lam * m.cos(theta / 2.0), a * cy * m.sin(theta / 2.0)

    def inv(m, x, y):
        theta = m.let(m.asin(clamp(m, y / (a * cy), -1.0, 1.0)))
        c = m.let(m.cos(theta))
        edge = m.let(m.abs(c) < 1e-12)
        lam = m.let(m.where(edge, 0.0, x / (a * cx) / m.where(edge, 1.0, c)))
        lat = m.asin(clamp(m, (2 * theta + m.sin(2 * theta)) / math.pi, -1.0, 1.0))
        out = m.let(m.abs(lam) > math.pi + 1e-10)
        return m.where(out, math.nan, lam), m.where(out, math.nan, lat)

    return framed(p, fwd, inv)


#: The polynomial of the Equal Earth projection.
EQUAL_EARTH = (1.340264, -0.081106, 0.000893, 0.003796)
SQRT3_2 = math.sqrt(3) / 2


@operator("eqearth")
def eqearth(p: Params) -> Op:
    e = p.ellps()
    r = e.a * math.sqrt(e.qp / 2)
    a1, a2, a3, a4 = EQUAL_EARTH

    def height(t):
        t2 = t * t
        return t * (a1 + a2 * t2 + t2 * t2 * t2 * (a3 + a4 * t2))

    def slope(t):
        t2 = t * t
        return a1 + 3 * a2 * t2 + t2 * t2 * t2 * (7 * a3 + 9 * a4 * t2)

    def fwd(m, lam, lat):
        t = m.let(m.asin(SQRT3_2 * clamp(m, e.qs(m, m.sin(lat)) / e.qp, -1.0, 1.0)))
        return r * lam * m.cos(t) / (SQRT3_2 * slope(t)), r * height(t)

    def inv(m, x, y):
        top = float(height(math.asin(SQRT3_2)))
        v = m.let(clamp(m, y / r, -top, top))
        t = v
        for _ in range(8):
            t = m.let(t - (height(t) - v) / slope(t))
        return SQRT3_2 / r * x * slope(t) / m.cos(t), authalic_inverse(m, e, e.qp * clamp(m, m.sin(t) / SQRT3_2, -1.0, 1.0))

    return framed(p, fwd, inv, wrap=False)


#: Lengths of parallels and distances from the equator every 5 degrees, as cubics in degrees.
ROBINSON_X = (
    (1.0, 2.2199e-17, -7.15515e-05, 3.1103e-06), (0.9986, -0.000482243, -2.4897e-05, -1.3309e-06), (0.9954, -0.00083103, -4.48605e-05, -9.86701e-07),
    (0.99, -0.00135364, -5.9661e-05, 3.6777e-06), (0.9822, -0.00167442, -4.49547e-06, -5.72411e-06), (0.973, -0.00214868, -9.03571e-05, 1.8736e-08),
    (0.96, -0.00305085, -9.00761e-05, 1.64917e-06), (0.9427, -0.00382792, -6.53386e-05, -2.6154e-06), (0.9216, -0.00467746, -0.00010457, 4.81243e-06),
    (0.8962, -0.00536223, -3.23831e-05, -5.43432e-06), (0.8679, -0.00609363, -0.000113898, 3.32484e-06), (0.835, -0.00698325, -6.40253e-05, 9.34959e-07),
    (0.7986, -0.00755338, -5.00009e-05, 9.35324e-07), (0.7597, -0.00798324, -3.5971e-05, -2.27626e-06), (0.7186, -0.00851367, -7.01149e-05, -8.6303e-06),
    (0.6732, -0.00986209, -0.000199569, 1.91974e-05), (0.6213, -0.010418, 8.83923e-05, 6.24051e-06), (0.5722, -0.00906601, 0.000182, 6.24051e-06), (0.5322, -0.00677797, 0.000275608, 6.24051e-06),
)
ROBINSON_Y = (
    (-5.20417e-18, 0.0124, 1.21431e-18, -8.45284e-11), (0.062, 0.0124, -1.26793e-09, 4.22642e-10), (0.124, 0.0124, 5.07171e-09, -1.60604e-09),
    (0.186, 0.0123999, -1.90189e-08, 6.00152e-09), (0.248, 0.0124002, 7.10039e-08, -2.24e-08), (0.31, 0.0123992, -2.64997e-07, 8.35986e-08),
    (0.372, 0.0124029, 9.88983e-07, -3.11994e-07), (0.434, 0.0123893, -3.69093e-06, -4.35621e-07), (0.4958, 0.0123198, -1.02252e-05, -3.45523e-07),
    (0.5571, 0.0121916, -1.54081e-05, -5.82288e-07), (0.6176, 0.0119938, -2.41424e-05, -5.25327e-07), (0.6769, 0.011713, -3.20223e-05, -5.16405e-07),
    (0.7346, 0.0113541, -3.97684e-05, -6.09052e-07), (0.7903, 0.0109107, -4.89042e-05, -1.04739e-06), (0.8435, 0.0103431, -6.4615e-05, -1.40374e-09),
    (0.8936, 0.00969686, -6.4636e-05, -8.547e-06), (0.9394, 0.00840947, -0.000192841, -4.2106e-06), (0.9761, 0.00616527, -0.000256, -4.2106e-06), (1.0, 0.00328947, -0.000319159, -4.2106e-06),
)
ROBINSON_SCALE = (0.8487, 1.3523)


def _single(table):
    """Coefficients as they are held in single precision, by power."""
    import numpy as np

    return [[float(np.float32(row[k])) for row in table] for k in range(4)]


@operator("robin")
def robin(p: Params) -> Op:
    a = p.ellps().a
    xs, ys = _single(ROBINSON_X), _single(ROBINSON_Y)
    fx, fy = ROBINSON_SCALE

    def cubic(m, table, i, z):
        c = [m.let(m.pick(t, i)) for t in table]
        return c[0] + z * (c[1] + z * (c[2] + z * c[3]))

    def fwd(m, lam, lat):
        size = m.let(m.abs(lat))
        i = m.let(m.minimum(m.floor(size * (36 / math.pi) + 1e-15), 18.0))
        z = m.let((size - i * (math.pi / 36)) * (180 / math.pi))
        y = a * fy * cubic(m, ys, i, z)
        return a * fx * lam * cubic(m, xs, i, z), m.where(lat < 0, -y, y)

    def inv(m, x, y):
        v = m.let(m.abs(y) / (a * fy))
        i = 0.0
        for k in range(1, 18):  # how many nodes lie below
            i = i + m.where(v >= ys[0][k], 1.0, 0.0)
        i = m.let(i)
        c0, c1, c2, c3 = (m.let(m.pick(t, i)) for t in ys)
        z = m.let((v - c0) / c1)
        for _ in range(6):
            z = m.let(z - (c0 + z * (c1 + z * (c2 + z * c3)) - v) / (c1 + z * (2 * c2 + z * 3 * c3)))
        top, out = m.let(v >= 1), m.let(v > 1.000001)
        lat = m.where(top, HALF, (5 * i + z) * (math.pi / 180))
        lam = m.let(x / (a * fx) / m.where(top, xs[0][18], cubic(m, xs, i, z)))
        out = m.let(out | (m.abs(lam) > math.pi))
        return m.where(out, math.nan, lam), m.where(out, math.nan, m.where(y < 0, -lat, lat))

    return framed(p, fwd, inv)


@operator("qsc")
def qsc(p: Params) -> Op:
    """One of six faces of a cube around the globe, chosen by lat_0 and lon_0."""
    e, lat_0, lon_0 = p.ellps(), p.lat_0, p.lon_0
    a, near = e.a, abs(lon_0)
    face = "top" if lat_0 >= HALF - QUARTER / 2 else "bottom" if lat_0 <= QUARTER / 2 - HALF else "front" if near <= QUARTER else "back" if near > HALF + QUARTER else "right" if lon_0 > 0 else "left"
    turn = {"front": 0.0, "right": HALF, "back": math.pi, "left": -HALF}.get(face)

    def split(m, angle):
        """Which quarter around the axis an angle lies in (0 to 3), and what is left of it, 45 degrees at most."""
        quarter = m.let(m.floor((angle + QUARTER) / HALF))
        return m.let(quarter - 4 * m.floor(quarter / 4.0)), m.let(angle - quarter * HALF)

    def fwd(m, lon, lat):
        lat = m.let(e.geocentric(m, lat))
        if turn is None:
            s = 1.0 if face == "top" else -1.0
            phi, angle = m.let(HALF - s * lat, s * (lon - HALF))
        else:
            # axes of the face: q outward, r to the east, s to the north
            lam = m.let(lon - turn)
            q, r, s = m.let(m.cos(lat) * m.cos(lam), m.cos(lat) * m.sin(lam), m.sin(lat))
            phi, angle = m.let(m.acos(clamp(m, q, -1.0, 1.0)), m.atan2(s, r))
        quarter, theta = split(m, angle)
        theta = m.let(m.where(phi < 1e-10, 0.0, theta))
        mu = m.let(m.atan(12 / math.pi * (theta + m.acos(m.sin(theta) * math.cos(QUARTER)) - HALF)))
        c = m.let(m.cos(mu))
        t = m.let(m.sqrt((1 - m.cos(phi)) / (c * c) / (1 - m.cos(m.atan(1 / m.cos(theta))))))
        mu = m.let(mu + quarter * HALF)
        return a * t * m.cos(mu), a * t * m.sin(mu)

    def inv(m, x, y):
        x, y = m.let(x / a, y / a)
        quarter, mu = split(m, m.atan2(y, x))
        t = m.let(math.pi / 12 * m.tan(mu))
        theta = m.let(m.atan(m.sin(t) / (m.cos(t) - math.sqrt(0.5))))
        c, tn = m.let(m.cos(mu), m.hypot(x, y))
        q = m.let(clamp(m, 1 - c * c * tn * tn * (1 - m.cos(m.atan(1 / m.cos(theta)))), -1.0, 1.0))
        angle = m.let(theta + quarter * HALF)
        if turn is None:
            s = 1.0 if face == "top" else -1.0
            lat, lon = s * (HALF - m.acos(q)), s * angle + HALF
        else:
            w = m.let(m.sqrt(1 - q * q))
            lat, lon = m.asin(clamp(m, w * m.sin(angle), -1.0, 1.0)), m.atan2(w * m.cos(angle), q) + turn
        lon = m.let(lon)
        return lon - 2 * math.pi * m.floor((lon + math.pi) / (2 * math.pi)), e.from_geocentric(m, lat)

    return plane(fwd, inv)
