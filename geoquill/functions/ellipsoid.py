"""Ellipsoids: shape, curvature, latitudes, meridian arcs, cartesian coordinates, gravity.

Series coefficients are not tabulated. Each auxiliary latitude is an odd function of another with period pi; its
Fourier sine coefficients are computed in the driver from the function itself, to double precision.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np

from .mathx import Np, sine_series

#: Name, semimajor axis, reciprocal flattening (0: sphere).
NAMED = {
    "MERIT": (6378137, 298.257), "SGS85": (6378136, 298.257), "GRS80": (6378137, 298.2572221008827), "IAU76": (6378140, 298.257),
    "airy": (6377563.396, 299.3249646), "APL4.9": (6378137, 298.25), "NWL9D": (6378145, 298.25), "mod_airy": (6377340.189, 299.3249373654824),
    "andrae": (6377104.43, 300.0), "danish": (6377019.2563, 300.0), "aust_SA": (6378160, 298.25), "GRS67": (6378160, 298.2471674270),
    "GSK2011": (6378136.5, 298.2564151), "bessel": (6377397.155, 299.1528128), "bess_nam": (6377483.865, 299.1528128), "clrk66": (6378206.4, 294.9786982138982),
    "clrk80": (6378249.145, 293.4663), "clrk80ign": (6378249.2, 293.4660212936269), "CPM": (6375738.7, 334.29), "delmbr": (6376428, 311.5),
    "engelis": (6378136.05, 298.2566), "evrst30": (6377276.345, 300.8017), "evrst48": (6377304.063, 300.8017), "evrst56": (6377301.243, 300.8017),
    "evrst69": (6377295.664, 300.8017), "evrstSS": (6377298.556, 300.8017), "fschr60": (6378166, 298.3), "fschr60m": (6378155, 298.3),
    "fschr68": (6378150, 298.3), "helmert": (6378200, 298.3), "hough": (6378270, 297.0), "intl": (6378388, 297.0),
    "krass": (6378245, 298.3), "kaula": (6378163, 298.24), "lerch": (6378139, 298.257), "mprts": (6397300, 191.0),
    "new_intl": (6378157.5, 298.2496153900135), "plessis": (6376523, 308.64099709583735), "PZ90": (6378136, 298.25784), "SEasia": (6378155, 298.3000002408657),
    "walbeck": (6376896, 302.78000018165636), "WGS60": (6378165, 298.3), "WGS66": (6378145, 298.25), "WGS72": (6378135, 298.26),
    "WGS84": (6378137, 298.257223563), "sphere": (6370997, 0.0), "unitsphere": (1, 0.0),
}
ORDER = 6


def _sine_coefficients(g, order: int = ORDER, points: int = 128) -> list[float]:
    """c[k] of g(a) = a + sum of c[k] sin(2 (k + 1) a)."""
    a = math.pi * (np.arange(points) + 0.5) / points - math.pi / 2
    d = g(a) - a
    return [float(2 / points * np.sum(d * np.sin(2 * k * a))) for k in range(1, order + 1)]


def _inverted(g):
    """The inverse of a function that differs from the identity by little."""

    def inverse(b):
        a = b.copy()
        for _ in range(60):
            a = a - (g(a) - b)
        return a

    return inverse


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    f: float

    @staticmethod
    @lru_cache(None)
    def named(text: str) -> Ellipsoid:
        """A known name, or "a, rf" with or without parentheses; a reciprocal flattening of 0 means a sphere."""
        if text in NAMED:
            a, rf = NAMED[text]
        else:
            try:
                a, rf = (float(x) for x in text.strip("() ").split(","))
            except ValueError:
                raise ValueError(f"unknown ellipsoid: {text}") from None
        if not (math.isfinite(a) and a > 0) or (rf != 0 and not abs(rf) > 1):
            raise ValueError(f"ellipsoid out of range: {text}")
        return Ellipsoid(float(a), 1 / rf if rf else 0.0)

    # -- shape
    @property
    def b(self) -> float:
        return self.a * (1 - self.f)

    @property
    def es(self) -> float:
        return self.f * (2 - self.f)

    @property
    def e(self) -> float:
        return math.sqrt(self.es)

    @property
    def second_es(self) -> float:
        return self.es / (1 - self.es)

    @property
    def second_f(self) -> float:
        return self.f / (1 - self.f)

    @property
    def n(self) -> float:
        return self.f / (2 - self.f)

    @property
    def aspect_ratio(self) -> float:
        return 1 - self.f

    @property
    def linear_eccentricity(self) -> float:
        return math.sqrt(self.a**2 - self.b**2)

    @property
    def polar_radius(self) -> float:
        return self.a * self.a / self.b

    @property
    def spherical(self) -> bool:
        return self.f == 0

    # -- curvature
    def prime_vertical(self, m, lat):
        s = m.let(m.sin(lat))
        return self.a / m.sqrt(1 - self.es * s * s)

    def meridian(self, m, lat):
        s = m.let(m.sin(lat))
        w = m.let(1 - self.es * s * s)
        return self.a * (1 - self.es) / (w * m.sqrt(w))

    # -- auxiliary latitudes: exact functions of arrays, and series for any values
    def _mu(self, phi):
        """Rectifying latitude by quadrature."""
        x, w = np.polynomial.legendre.leggauss(48)
        half = np.asarray(phi)[..., None] / 2
        arc = (half * w / (1 - self.es * np.sin(half * (x + 1)) ** 2) ** 1.5).sum(-1)
        whole = (math.pi / 4 * w / (1 - self.es * np.sin(math.pi / 4 * (x + 1)) ** 2) ** 1.5).sum()
        return math.pi / 2 * arc / whole

    def _chi(self, phi):
        s = np.sin(phi)
        return np.arctan(np.sinh(np.arctanh(np.clip(s, -1 + 1e-17, 1 - 1e-17)) - self.e * np.arctanh(self.e * s)))

    def _xi(self, phi):
        q = self.qs(Np, np.sin(phi)) / self.qs(Np, 1.0)
        return np.arcsin(np.clip(q, -1, 1))

    def _series(self, g):
        return _sine_coefficients(g), _sine_coefficients(_inverted(g))

    @cached_property
    def rectifying(self) -> tuple[list[float], list[float]]:
        return self._series(self._mu)

    @cached_property
    def conformal(self) -> tuple[list[float], list[float]]:
        return self._series(self._chi)

    @cached_property
    def authalic(self) -> tuple[list[float], list[float]]:
        return self._series(self._xi)

    @cached_property
    def mercator(self) -> tuple[list[float], list[float]]:
        """Between conformal and rectifying latitude: the series of the transverse Mercator projection."""
        chi = _inverted(self._chi)
        g = lambda x: self._mu(chi(x))
        return self._series(g)

    def along(self, m, series: list[float], angle):
        angle = m.let(angle)
        return angle if self.spherical else angle + sine_series(m, series, 2 * angle)

    @cached_property
    def rectifying_radius(self) -> float:
        x, w = np.polynomial.legendre.leggauss(48)
        return float(self.a * (1 - self.es) * (w / (1 - self.es * np.sin(math.pi / 4 * (x + 1)) ** 2) ** 1.5).sum() / 2)

    @property
    def quadrant(self) -> float:
        return math.pi / 2 * self.rectifying_radius

    def arc(self, m, lat):
        """Distance along the meridian from the equator."""
        return self.rectifying_radius * self.along(m, self.rectifying[0], lat)

    def lat_of_arc(self, m, d):
        return self.along(m, self.rectifying[1], d / self.rectifying_radius)

    def geocentric(self, m, lat):
        return m.atan((1 - self.es) * m.tan(lat))

    def from_geocentric(self, m, lat):
        return m.atan(m.tan(lat) / (1 - self.es))

    def reduced(self, m, lat):
        return m.atan((1 - self.f) * m.tan(lat))

    def from_reduced(self, m, lat):
        return m.atan(m.tan(lat) / (1 - self.f))

    def isometric(self, m, lat):
        lat = m.let(lat)
        return m.asinh(m.tan(lat)) - self.e * m.atanh(self.e * m.sin(lat))

    def from_isometric(self, m, psi):
        return m.atan(self.tan_of_sinh(m, m.sinh(psi)))

    def ts(self, m, lat):
        """exp(-isometric latitude)."""
        lat = m.let(lat)
        s, c = m.let(m.sin(lat), m.cos(lat))
        return m.exp(self.e * m.atanh(self.e * s)) * m.where(s > 0, c / (1 + s), (1 - s) / c)

    def lat_of_ts(self, m, ts):
        ts = m.let(ts)
        return m.atan(self.tan_of_sinh(m, (1 / ts - ts) / 2))

    def tan_of_sinh(self, m, taup, rounds: int = 4):
        """Tangent of the latitude from the sinh of its isometric latitude, by Newton's method."""
        if self.spherical:
            return taup
        taup = m.let(taup)
        big = float(math.exp(self.e * math.atanh(self.e)))
        tau = m.let(m.where(m.abs(taup) > 70, taup * big, taup / (1 - self.es)))
        for _ in range(rounds):
            t1 = m.let(m.sqrt(1 + tau * tau))
            sig = m.let(m.sinh(self.e * m.atanh(self.e * tau / t1)))
            tp = m.let(m.sqrt(1 + sig * sig) * tau - sig * t1)
            step = (taup - tp) * (1 + (1 - self.es) * tau * tau) / ((1 - self.es) * t1 * m.sqrt(1 + tp * tp))
            # where the tangent is huge, the guess is exact and the step isn't a number
            tau = m.let(m.where(m.abs(tau) < 1e8, tau + step, tau))
        return tau

    def qs(self, m, s):
        if self.e < 1e-7:
            return 2 * s
        s = m.let(s)
        return (1 - self.es) * (s / (1 - self.es * s * s) + m.atanh(self.e * s) / self.e)

    @cached_property
    def qp(self) -> float:
        return float(self.qs(Np, 1.0))

    def msfn(self, m, lat):
        s = m.let(m.sin(lat))
        return m.cos(lat) / m.sqrt(1 - self.es * s * s)

    # -- cartesian
    def cartesian(self, m, lon, lat, h):
        s, c = m.let(m.sin(lat), m.cos(lat))
        nu = m.let(self.a / m.sqrt(1 - self.es * s * s))
        return (nu + h) * c * m.cos(lon), (nu + h) * c * m.sin(lon), (nu * (1 - self.es) + h) * s

    def geographic(self, m, x, y, z):
        """By Bowring's formula with Fukushima's rounds on the reduced latitude."""
        p = m.let(m.hypot(x, y))
        t = m.let(z / (p * (1 - self.f)))
        for _ in range(3):
            c = m.let(1 / m.sqrt(1 + t * t))
            s = m.let(t * c)
            lat_t = (z + self.second_es * self.b * s * s * s) / (p - self.es * self.a * c * c * c)
            t = m.let((1 - self.f) * lat_t)
        lat = m.let(m.where(p < 1e-12, copysign_half_pi(m, z), m.atan(t / (1 - self.f))))
        s, c = m.let(m.sin(lat), m.cos(lat))
        h = p * c + z * s - self.a * m.sqrt(1 - self.es * s * s)
        return m.where(p < 1e-12, 0.0, m.atan2(y, x)), lat, h


def copysign_half_pi(m, z):
    return m.where(z < 0, -math.pi / 2, math.pi / 2)


# -- normal gravity; latitudes in radians, heights in metres, results in m/s2
#: Equatorial gravity, then coefficients of sin^2(lat) and sin^2(2 lat).
CLASSIC = {"cassinis": (9.78049, 5.2884e-3, 5.9e-6), "jeffreys": (9.780373, 5.2884e-3, 5.9e-6), "grs67": (9.780318, 5.3024e-3, 5.9e-6), "welmec": (9.780318, 5.3024e-3, 5.8e-6)}
#: Equatorial gravity, then a power series in sin^2(lat).
GRS80_SERIES = (9.7803267715, 5.2790414e-3, 2.327180e-5, 1.262e-7, 7.0e-10)


def gravity(m, model: str, lat, h):
    """Normal gravity at a height, by one of the formulas cassinis, jeffreys, grs67, grs80, welmec."""
    s = m.sin(lat)
    s1 = m.let(s * s)
    if model == "grs80":
        g, c1, c2, c3, c4 = GRS80_SERIES
        normal = g * (1 + s1 * (c1 + s1 * (c2 + s1 * (c3 + s1 * c4))))
    else:
        g, b1, b2 = CLASSIC[model]
        s2 = m.sin(2 * lat)
        normal = g * (1 + s1 * b1 - s2 * s2 * b2)
    if model == "welmec":
        return normal - 0.000003085 * h
    if model in ("cassinis", "jeffreys"):  # free air, and a plate of density 2800
        return normal - (3.08e-6 - 4.19e-10 * 2800) * h
    return normal - ((3.0877e-6 - 4.3e-9 * s1) + 7.2e-13 * h) * h


def somigliana(m, ellps: Ellipsoid, lat, equator: float = 9.7803267715, pole: float = 9.8321863685):
    s = m.let(m.sin(lat))
    k = ellps.b * pole / (ellps.a * equator) - 1
    return equator * (1 + k * s * s) / m.sqrt(1 - ellps.es * s * s)
