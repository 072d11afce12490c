"""Elementary operators: counting up, angles in ISO 6709 form, curvature, gravity, geodesics."""

from __future__ import annotations

import math
from functools import partial

from ..functions import geodesics
from ..functions.angles import degrees_to_packed, packed_to_degrees
from ..functions.ellipsoid import gravity
from ..functions.mathx import Np
from ..plans.parameters import Params
from ..plans.registry import Op, operator

RAD = math.pi / 180


@operator("noop")
def noop(p: Params) -> Op:
    same = lambda m, x, y, z, t: (x, y, z, t)
    return Op(same, same)


@operator("addone")
def addone(p: Params) -> Op:
    return Op(lambda m, x, y, z, t: (x + 1.0, y, z, t), lambda m, x, y, z, t: (x - 1.0, y, z, t))


def _iso(places: int):
    def build(p: Params) -> Op:
        # latitude first in the packed form
        fwd = lambda m, x, y, z, t: (packed_to_degrees(m, y, places) * RAD, packed_to_degrees(m, x, places) * RAD, z, t)
        inv = lambda m, x, y, z, t: (degrees_to_packed(m, y / RAD, places), degrees_to_packed(m, x / RAD, places), z, t)
        return Op(fwd, inv)

    return build


operator("dm")(_iso(1))
operator("dms")(_iso(2))


@operator("curvature")
def curvature(p: Params) -> Op:
    """Radii of curvature at latitude x (degrees)."""
    mode, ellps = p.one_of("prime", "meridian", "gaussian", "mean", "azimuthal"), p.ellps()

    def fwd(m, x, y, z, t):
        lat = m.let(x * RAD)
        n, r = m.let(ellps.prime_vertical(m, lat), ellps.meridian(m, lat))
        if mode == "prime":
            return n, y, z, t
        if mode == "meridian":
            return r, y, z, t
        if mode == "gaussian":
            return m.sqrt(n * r), y, z, t
        if mode == "mean":
            return 2 * n * r / (n + r), y, z, t
        azi = m.let(y * RAD)
        s, c = m.let(m.sin(azi), m.cos(azi))
        return 1 / (c * c / r + s * s / n), azi, z, t

    return Op(fwd)


@operator("gravity")
def normal_gravity(p: Params) -> Op:
    """Normal gravity at latitude x (degrees) and height y."""
    model, flat = p.one_of("cassinis", "jeffreys", "grs67", "grs80", "welmec", default="grs80"), p.flag("zero-height")
    p.ellps()
    return Op(lambda m, x, y, z, t: (gravity(m, model, x * RAD, 0.0 if flat else y), y, z, t))


@operator("geodesic")
def geodesic(p: Params) -> Op:
    """Forward: a point (lat, lon), azimuth and distance in degrees and metres, to the end's (lat, lon) and the start's.
    Inverse: two points (lat, lon) to the azimuths at both ends, the distance and the azimuth back; with reversible,
    to the second point, the azimuth back and the distance."""
    ellps, both_ways = p.ellps(), p.flag("reversible")

    def fwd(m, x, y, z, t):
        along = geodesics.direct if m is Np else partial(geodesics.direct_in, m)
        lon, lat, _ = along(ellps, y * RAD, x * RAD, z * RAD, t)
        return lat / RAD, lon / RAD, x, y

    def inv(m, x, y, z, t):
        between = geodesics.inverse if m is Np else partial(geodesics.inverse_in, m)
        az1, az2, s = between(ellps, y * RAD, x * RAD, t * RAD, z * RAD)
        turned = m.let(az2 / RAD + 180.0)
        back = turned - 360.0 * m.floor(turned / 360.0)
        return (z + 0 * s, t, back, s) if both_ways else (az1 / RAD, az2 / RAD, s, back)

    return Op(fwd, inv)
