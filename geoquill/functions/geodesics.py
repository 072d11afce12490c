"""Geodesics by Vincenty's formulas: on arrays, each element iterated until it converges, and as expressions.

As expressions the longitude on the auxiliary sphere takes two plain steps, one by Aitken's extrapolation and one more,
in generated code; that stands still to 1e-12 but for points near antipodes, and only those go on in a loop without
generated code, so no row leaves the JVM.
"""

from __future__ import annotations

import math

import numpy as np

from .ellipsoid import Ellipsoid
from .mathx import Np

ROUNDS = 1000


def _series(ellps: Ellipsoid, cos2_alpha):
    u2 = cos2_alpha * ellps.second_es
    k = (np.sqrt(1 + u2) - 1) / (np.sqrt(1 + u2) + 1)
    return (1 + k * k / 4) / (1 - k), k * (1 - 3 * k * k / 8)


def _whole(m, x):
    """x to the nearest whole number, halves away from zero as SQL's round: the sign of half a turn is an azimuth's."""
    near = m.let(m.rint(x))
    return m.let(m.where(m.abs(x - near) >= 0.5, x + 0.5 * m.sign(x), near))


def _delta(b, sin_s, cos_s, cos_2m):
    return b * sin_s * (cos_2m + b / 4 * (cos_s * (2 * cos_2m**2 - 1) - b / 6 * cos_2m * (4 * sin_s**2 - 3) * (4 * cos_2m**2 - 3)))


def direct(ellps: Ellipsoid, lon, lat, azimuth, distance):
    """lon, lat, azimuth at the end of a geodesic; radians and metres."""
    lon, lat, azimuth, distance = np.broadcast_arrays(*(np.asarray(v, float) for v in (lon, lat, azimuth, distance)))
    tan_u = (1 - ellps.f) * np.tan(lat)
    cos_u = 1 / np.sqrt(1 + tan_u**2)
    sin_u = tan_u * cos_u
    sin_a, cos_a = np.sin(azimuth), np.cos(azimuth)
    sigma1 = np.arctan2(tan_u, cos_a)
    sin_alpha = cos_u * sin_a
    cos2_alpha = 1 - sin_alpha**2
    a, b = _series(ellps, cos2_alpha)
    first = distance / (ellps.b * a)
    sigma, live = first.copy(), np.isfinite(first)
    rows = np.flatnonzero(live)  # only rows that still move are computed
    sigma, live = np.atleast_1d(sigma), np.atleast_1d(live).copy()
    first, b, sigma1 = (np.atleast_1d(v) for v in (first, b, sigma1))
    for _ in range(ROUNDS):
        if not len(rows):
            break
        old = sigma[rows]
        new = first[rows] + _delta(b[rows], np.sin(old), np.cos(old), np.cos(2 * sigma1[rows] + old))
        sigma[rows] = new
        rows = rows[np.abs(new - old) > 1e-13]
    live = np.isin(np.arange(len(sigma)), rows)
    shape = lon.shape
    sigma, live, sigma1, b = (v.reshape(shape) for v in (sigma, live, sigma1, b))
    cos_2m, sin_s, cos_s = np.cos(2 * sigma1 + sigma), np.sin(sigma), np.cos(sigma)
    x = sin_u * sin_s - cos_u * cos_s * cos_a
    lat2 = np.arctan2(sin_u * cos_s + cos_u * sin_s * cos_a, (1 - ellps.f) * np.hypot(sin_alpha, x))
    lam = np.arctan2(sin_s * sin_a, cos_u * cos_s - sin_u * sin_s * cos_a)
    c = ellps.f / 16 * cos2_alpha * (4 + ellps.f * (4 - 3 * cos2_alpha))
    lon2 = lon + lam - (1 - c) * ellps.f * sin_alpha * (sigma + c * sin_s * (cos_2m + c * cos_s * (2 * cos_2m**2 - 1)))
    good = ~live
    return tuple(np.where(good, v, np.nan) for v in (lon2, lat2, np.arctan2(sin_alpha, -x)))


def inverse(ellps: Ellipsoid, lon1, lat1, lon2, lat2):
    """Azimuths at both ends and the distance; radians and metres. No convergence (near antipodes) gives NaN;
    coincident points give zeros."""
    lon1, lat1, lon2, lat2 = np.broadcast_arrays(*(np.asarray(v, float) for v in (lon1, lat1, lon2, lat2)))
    t1, t2 = (1 - ellps.f) * np.tan(lat1), (1 - ellps.f) * np.tan(lat2)
    c1, c2 = 1 / np.sqrt(1 + t1**2), 1 / np.sqrt(1 + t2**2)
    s1, s2 = t1 * c1, t2 * c2
    span = lon2 - lon1
    span = span - 2 * np.pi * _whole(Np, span / (2 * np.pi))
    shape = span.shape
    s1, c1, s2, c2, span, lat1, lat2 = (np.atleast_1d(v) for v in (s1, c1, s2, c2, span, lat1, lat2))
    lam = span.copy()
    state = {k: np.full(span.shape, np.nan) for k in ("sin_s", "cos_s", "sigma", "cos2_alpha", "cos_2m")}
    with np.errstate(all="ignore"):
        rows = np.flatnonzero(np.isfinite(span))  # only rows that still move are computed
        still = np.zeros(span.shape, bool)
        for _ in range(ROUNDS):
            if not len(rows):
                break
            u1, v1, u2, v2, old = s1[rows], c1[rows], s2[rows], c2[rows], lam[rows]
            sin_l, cos_l = np.sin(old), np.cos(old)
            sin_s = np.hypot(v2 * sin_l, v1 * u2 - u1 * v2 * cos_l)
            cos_s = u1 * u2 + v1 * v2 * cos_l
            sigma = np.arctan2(sin_s, cos_s)
            sin_alpha = np.where(sin_s == 0, 0.0, v1 * v2 * sin_l / np.where(sin_s == 0, 1, sin_s))
            cos2_alpha = 1 - sin_alpha**2
            cos_2m = np.where(cos2_alpha == 0, 0.0, cos_s - 2 * u1 * u2 / np.where(cos2_alpha == 0, 1, cos2_alpha))
            c = ellps.f / 16 * cos2_alpha * (4 + ellps.f * (4 - 3 * cos2_alpha))
            new = span[rows] + (1 - c) * ellps.f * sin_alpha * (sigma + c * sin_s * (cos_2m + c * cos_s * (2 * cos_2m**2 - 1)))
            lam[rows] = new
            for k, v in zip(state, (sin_s, cos_s, sigma, cos2_alpha, cos_2m), strict=True):
                state[k][rows] = v
            # once more after coming to rest, for what is kept belongs to the longitude before the step
            now = np.abs(new - old) <= 1e-12
            done = now & still[rows]
            still[rows] = now
            rows = rows[~done]
        a, b = _series(ellps, state["cos2_alpha"])
        s = ellps.b * a * (state["sigma"] - _delta(b, state["sin_s"], state["cos_s"], state["cos_2m"]))
        sin_l, cos_l = np.sin(lam), np.cos(lam)
        az1 = np.arctan2(c2 * sin_l, c1 * s2 - s1 * c2 * cos_l)
        az2 = np.arctan2(c1 * sin_l, c1 * s2 * cos_l - s1 * c2)
    open_ = np.isin(np.arange(len(lam)), rows[~still[rows]])
    same = (span == 0) & (lat1 == lat2)
    return tuple(np.where(open_, np.nan, np.where(same, 0.0, v)).reshape(shape) for v in (az1, az2, s))


# -- as expressions ---------------------------------------------------------------------------

STILL = 1e-12


def _turn(m, ellps: Ellipsoid, c: dict, lam, spans: bool = True):
    """One step of the longitude, and what was found on the way."""
    sl, cl = m.let(m.sin(lam), m.cos(lam))
    cos_s, a, b = m.let(c["ss"] + c["cc"] * cl, c["c2"] * sl, c["c1s2"] - c["s1c2"] * cl)
    sin_s = m.let(m.hypot(a, b))
    sigma, sin_a = m.let(m.atan2(sin_s, cos_s), m.where(m.abs(sin_s) <= 0.0, 0.0, c["cc"] * sl / m.where(m.abs(sin_s) <= 0.0, 1.0, sin_s)))
    cos2_a = m.let(1 - sin_a * sin_a)
    cos_2m = m.let(m.where(m.abs(cos2_a) <= 0.0, 0.0, cos_s - 2 * c["ss"] / m.where(m.abs(cos2_a) <= 0.0, 1.0, cos2_a)))
    k = m.let(ellps.f / 16 * cos2_a * (4 + ellps.f * (4 - 3 * cos2_a)))
    new = m.let(c["span"] + (1 - k) * ellps.f * sin_a * (sigma + k * sin_s * (cos_2m + k * cos_s * (2 * cos_2m * cos_2m - 1))))
    if spans:
        new = m.let(m.where(m.let(m.failed(new, sigma)), math.nan, new))  # a span of generated code ends where it would get long
    return new, (sin_s, cos_s, sigma, cos2_a, cos_2m)


def inverse_in(m, ellps: Ellipsoid, lon1, lat1, lon2, lat2):
    """`inverse` in terms of the functions m of columns."""
    t1, t2 = m.let((1 - ellps.f) * m.tan(lat1), (1 - ellps.f) * m.tan(lat2))
    c1, c2 = m.let(1 / m.sqrt(1 + t1 * t1), 1 / m.sqrt(1 + t2 * t2))
    s1, s2, span = m.let(t1 * c1, t2 * c2, lon2 - lon1)
    span = m.let(span - 2 * math.pi * _whole(m, m.let(span / (2 * math.pi))))
    c = dict(zip(("ss", "cc", "c1s2", "s1c2"), m.let(s1 * s2, c1 * c2, c1 * s2, s1 * c2), strict=True)) | {"span": span, "c2": c2}
    one, _ = _turn(m, ellps, c, span)
    two, _ = _turn(m, ellps, c, one)
    bend = m.let(two - 2 * one + span)
    guess = m.let(m.where(m.abs(bend) > 1e-14, span - (one - span) * (one - span) / bend, two))
    three, _ = _turn(m, ellps, c, guess)
    start = m.let(m.where(m.abs(three - guess) <= STILL, three, two))
    rest = m.until({"lam": start, "done": (m.abs(three - guess) <= STILL) | m.isnan(three)}, lambda w, s: _step(w, ellps, c, s["lam"]), "done", ROUNDS)
    lam, done = m.let(rest["lam"], rest["done"])
    _, (sin_s, cos_s, sigma, cos2_a, cos_2m) = _turn(m, ellps, c, lam)
    u = m.let(m.sqrt(1 + cos2_a * ellps.second_es))
    k = m.let((u - 1) / (u + 1))
    a, b = m.let((1 + k * k / 4) / (1 - k), k * (1 - 3 * k * k / 8))
    delta = b * sin_s * (cos_2m + b / 4 * (cos_s * (2 * cos_2m * cos_2m - 1) - b / 6 * cos_2m * (4 * sin_s * sin_s - 3) * (4 * cos_2m * cos_2m - 3)))
    sl, cl = m.let(m.sin(lam), m.cos(lam))
    same = (m.abs(span) <= 0.0) & (m.abs(lat1 - lat2) <= 0.0)
    out = (m.atan2(c2 * sl, c["c1s2"] - c["s1c2"] * cl), m.atan2(c1 * sl, c["c1s2"] * cl - c["s1c2"]), ellps.b * a * (sigma - delta))
    return tuple(m.let(m.where(done, m.where(same, 0.0, v), math.nan)) for v in out)


def _step(m, ellps: Ellipsoid, c: dict, lam) -> dict:
    new, _ = _turn(m, ellps, c, lam, False)
    return {"lam": new, "done": (m.abs(new - lam) <= STILL) | m.isnan(new)}


def direct_in(m, ellps: Ellipsoid, lon, lat, azimuth, distance):
    """`direct` in terms of the functions m of columns: the arc's equation by steps that shrink a thousandfold each."""
    t = m.let((1 - ellps.f) * m.tan(lat))
    cu = m.let(1 / m.sqrt(1 + t * t))
    su, sa, ca = m.let(t * cu, m.sin(azimuth), m.cos(azimuth))
    sigma1, sin_a = m.let(m.atan2(t, ca), cu * sa)
    cos2_a = m.let(1 - sin_a * sin_a)
    u = m.let(m.sqrt(1 + cos2_a * ellps.second_es))
    k = m.let((u - 1) / (u + 1))
    a, b = m.let((1 + k * k / 4) / (1 - k), k * (1 - 3 * k * k / 8))
    first = m.let(distance / (ellps.b * a))
    sigma = first
    for _ in range(6):
        ss, cs, c2 = m.let(m.sin(sigma), m.cos(sigma), m.cos(2 * sigma1 + sigma))
        sigma = m.let(first + b * ss * (c2 + b / 4 * (cs * (2 * c2 * c2 - 1) - b / 6 * c2 * (4 * ss * ss - 3) * (4 * c2 * c2 - 3))))
    c2, ss, cs = m.let(m.cos(2 * sigma1 + sigma), m.sin(sigma), m.cos(sigma))
    x = m.let(su * ss - cu * cs * ca)
    lat2 = m.atan2(su * cs + cu * ss * ca, (1 - ellps.f) * m.hypot(sin_a, x))
    lam = m.atan2(ss * sa, cu * cs - su * ss * ca)
    c = m.let(ellps.f / 16 * cos2_a * (4 + ellps.f * (4 - 3 * cos2_a)))
    lon2 = lon + lam - (1 - c) * ellps.f * sin_a * (sigma + c * ss * (c2 + c * cs * (2 * c2 * c2 - 1)))
    return m.let(lon2), m.let(lat2), m.let(m.atan2(sin_a, -x))
