"""Handwritten SQL for the operators with longer formulas: each named step of a formula is a column of a further table.
Iterations are written out a fixed number of times, or are recursive queries that stop row by row."""

from __future__ import annotations

from dataclasses import dataclass
from math import asin, atan, atan2, atanh, cos, exp, log, pi, radians, sin, sqrt, tan

import numpy as np

from .oracles import A, EC, ES, NU, N, RHO, MS, arc, arc_of, conic, d, m_of, pts, psi, psi_of, q_of, qs, transverse, F

#: Steps of a formula: tables after each other, each with named expressions over the one before.
Steps = list[dict[str, str]]


def chain(area: str, steps: Steps, x: str, y: str, digits: int = 3, shift: tuple[float, float] = (0.0, 0.0)) -> str:
    out, last = pts(area), "pts"
    if any(shift):
        out += f", moved AS (SELECT * REPLACE (phi + {d(radians(shift[0]))} AS phi, lam + {d(radians(shift[1]))} AS lam) FROM pts)"
        last = "moved"
    for k, step in enumerate(steps):
        out += f", s{k} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in step.items())} FROM {last})"
        last = f"s{k}"
    return f"{out} SELECT k, round({x}, {digits}) + 0.0 AS x, round({y}, {digits}) + 0.0 AS y FROM {last}"


def from_lon(lon_0: float) -> str:
    return f"(lam - {d(radians(lon_0))})"


@dataclass(frozen=True)
class Ellipse:
    """Another ellipsoid than the default."""

    a: float
    rf: float

    @property
    def es(self) -> float:
        return (2 - 1 / self.rf) / self.rf

    @property
    def n(self) -> float:
        return 1 / (2 * self.rf - 1)

    def arc(self, phi: str = "phi") -> str:
        n = self.n
        return f"({d(self.a / (1 + n))} * ({d(1 + n**2 / 4 + n**4 / 64)} * {phi} - {d(1.5 * (n - n**3 / 8))} * sin(2 * {phi}) + {d(15 / 16 * (n**2 - n**4 / 4))} * sin(4 * {phi}) - {d(35 / 48 * n**3)} * sin(6 * {phi}) + {d(315 / 512 * n**4)} * sin(8 * {phi})))"

    def arc_of(self, p: float) -> float:
        n = self.n
        return self.a / (1 + n) * ((1 + n**2 / 4 + n**4 / 64) * p - 1.5 * (n - n**3 / 8) * sin(2 * p) + 15 / 16 * (n**2 - n**4 / 4) * sin(4 * p) - 35 / 48 * n**3 * sin(6 * p) + 315 / 512 * n**4 * sin(8 * p))

    def psi(self, phi: str = "phi") -> str:
        e = d(sqrt(self.es))
        return f"(asinh(tan({phi})) - {e} * atanh({e} * sin({phi})))"

    def psi_of(self, p: float) -> float:
        e = sqrt(self.es)
        return float(np.arcsinh(tan(p))) - e * atanh(e * sin(p))


CLARKE66, BESSEL, INTERNATIONAL = Ellipse(6378206.4, 294.9786982138982), Ellipse(6377397.155, 299.1528128), Ellipse(6378388.0, 297.0)


def bowring(lon_0: float, k_0: float, x_0: float) -> str:
    """Transverse Mercator of low order."""
    eps = d(ES / (1 - ES))
    steps = [
        {"s": "sin(phi)", "c": "cos(phi)", "l": from_lon(lon_0), "n": NU, "m": arc()},
        {"oo": "l * l", "cc": "c * c", "hf": "sin(l / 2)", "z": f"{eps} / 6 * l * l * l * c * c * c * c * c"},
        {"th": "atan2(2 * s * c * hf * hf, s * s + cc * cos(l))"},
    ]
    x = f"{d(x_0)} + {d(k_0)} * n * (atanh(c * sin(l)) + z * (1 + oo * (36 * cc - 29) / 10))"
    return chain("nordic", steps, x, f"{d(k_0)} * (m + n * th + z * n * l * s / 4 * (9 + 4 * {eps} * cc + oo * (20 * cc - 11)))")


def cones() -> dict[str, str]:
    p1, q90 = radians(50), q_of(pi / 2)
    n = m_of(p1) ** 2 / (q90 - q_of(p1))
    leac = conic(n, A, sqrt(n * q90) / n, f"(sqrt({d(n * q90)} - {d(n)} * {qs()}) / {d(n)})", 12)
    p0 = radians(55)
    nu, rho = A / sqrt(1 - ES * sin(p0) ** 2), A * (1 - ES) / (1 - ES * sin(p0) ** 2) ** 1.5
    # Lambert's conformal cone by a cubic in the meridian arc
    lcca = [{"s": f"{arc()} - {d(arc_of(p0))}", "th": f"{d(sin(p0))} * {from_lon(12)}"}, {"r": f"{d(nu / tan(p0))} - s * (1 + s * s / {d(6 * nu * rho)})"}]
    t = (
        A * (1 - N + 5 / 4 * (N**2 - N**3) + 81 / 64 * (N**4 - N**5)), -3 / 2 * A * (N - N**2 + 7 / 8 * (N**3 - N**4) + 55 / 64 * N**5),
        15 / 16 * A * (N**2 - N**3 + 3 / 4 * (N**4 - N**5)), -35 / 48 * A * (N**3 - N**4 + 11 / 16 * N**5), 315 / 512 * A * (N**4 - N**5),
    )
    length = f"({d(t[0])} * phi + " + " + ".join(f"{d(v)} * sin({2 * i} * phi)" for i, v in enumerate(t) if i) + ")"
    at = t[0] * p0 + sum(v * sin(2 * i * p0) for i, v in enumerate(t) if i)
    lccnc = [{"s": f"{length} - {d(at)}", "th": f"{d(sin(p0))} * {from_lon(12)}"}, {"m": f"s + s * s * s / {d(6 * nu * rho)}"}, {"r": f"{d(nu / tan(p0))} - m"}]
    return {
        "leac_fwd": chain("nordic", [], *leac),
        "lcca_fwd": chain("nordic", lcca, "r * sin(th)", f"{d(nu / tan(p0))} - r * cos(th)"),
        "lccnc_fwd": chain("nordic", lccnc, "r * sin(th)", "m + r * sin(th) * tan(th / 2)"),
    }


def polar() -> str:
    """Universal polar stereographic, north."""
    k = 2 * A * 0.994 / sqrt((1 + EC) ** (1 + EC) * (1 - EC) ** (1 - EC))
    return chain("nordic", [{"rho": f"{d(k)} * exp(-{psi()})"}], "2000000 + rho * sin(lam)", "2000000 - rho * cos(lam)")


def mollweide() -> str:
    steps: Steps = [{"t0": "phi"}]
    steps += [{f"t{i + 1}": f"t{i} - (t{i} + sin(t{i}) - {d(pi)} * sin(phi)) / (1 + cos(t{i}))"} for i in range(8)]
    return chain("nordic", steps, f"{d(A * 2 * sqrt(2) / pi)} * lam * cos(t8 / 2)", f"{d(A * sqrt(2))} * sin(t8 / 2)")


def robinson() -> str:
    # fixed values: the cubics of the rows of 50 and 55 degrees, in single precision
    rows = {"x": ((0.8679, -0.00609363, -0.000113898, 3.32484e-06), (0.835, -0.00698325, -6.40253e-05, 9.34959e-07)), "y": ((0.6176, 0.0119938, -2.41424e-05, -5.25327e-07), (0.6769, 0.011713, -3.20223e-05, -5.16405e-07))}
    cubic = lambda r: "({} + z * ({} + z * ({} + z * {})))".format(*(d(float(np.float32(v))) for v in r))
    pick = {c: f"CASE WHEN i = 10 THEN {cubic(a)} ELSE {cubic(b)} END" for c, (a, b) in rows.items()}
    steps = [{"i": f"floor(phi * {d(36 / pi)} + 1e-15)"}, {"z": f"(phi - i * {d(pi / 36)}) * {d(180 / pi)}"}, {"cx": pick["x"], "cy": pick["y"]}]
    return chain("nordic", steps, f"{d(A * 0.8487)} * lam * cx", f"{d(A * 1.3523)} * cy")


def guam() -> str:
    e = CLARKE66
    steps = [{"l": from_lon(12), "m": f"cos(phi) / sqrt(1 - {d(e.es)} * sin(phi) * sin(phi))"}]
    return chain("nordic", steps, f"{d(e.a)} * l * m", f"{e.arc()} - {d(e.arc_of(radians(55)))} + {d(e.a / 2)} * l * l * m * sin(phi)")


def calcofi() -> str:
    lon_0, lat_0, turn = -2.11446638879113, 0.5960299395560635, pi / 6  # fixed values: line 80, station 60
    steps: Steps = [{"u": psi()}, {"v": f"u + ({d(lon_0)} - lam - (u - {d(psi_of(lat_0))}) * {d(tan(turn))}) * {d(cos(turn) * sin(turn))}"}, {"f0": "atan(sinh(v))"}]
    # the latitude of an isometric latitude
    steps += [{f"f{i + 1}": f"atan(sinh(v + {d(EC)} * atanh({d(EC)} * sin(f{i}))))"} for i in range(12)]
    return chain("nordic", steps, f"80 - (f12 - {d(lat_0)}) * {d(180 / pi * 5 / cos(turn))}", f"60 + (f12 - phi) * {d(180 / pi * 15 / sin(turn))}")


def col_urban() -> str:
    p0, h = radians(55), 100.0
    nu, rho = A / sqrt(1 - ES * sin(p0) ** 2), A * (1 - ES) / (1 - ES * sin(p0) ** 2) ** 1.5
    middle = f"((phi + {d(p0)}) / 2)"
    steps = [{"v": f"{from_lon(10)} * {MS}", "rm": f"{d(A * (1 - ES))} / pow(1 - {d(ES)} * pow(sin({middle}), 2), 1.5::DOUBLE)"}]
    return chain("nordic", steps, f"{d(A * (1 + h / nu))} * v", f"{d(rho)} * (1 + {d(h)} / rm) * (phi - {d(p0)} + {d(tan(p0) * A * A / (2 * rho * nu))} * v * v)")


def roussilhe() -> str:
    p0 = radians(55)
    w = 1 - ES * sin(p0) ** 2
    c = w * w / (1 - ES)  # one over the product of the radii of curvature
    t, q, n = tan(p0), 2 * ES * sin(p0) ** 2, 1 / sqrt(w)
    steps = [{"s": f"{arc()} / {d(A)} - {d(arc_of(p0) / A)}", "v": f"{from_lon(12)} * {MS}"}]
    x = (
        f"v + {d(c / 4)} * v * s * s - {d(c * (2 * t * t - 1 - q) / 12)} * v * v * v - {d(c * t * (1 + 4 * t * t) / (12 * n))} * v * v * v * s"
        f" + {d(c * c / 24)} * v * pow(s, 4) - {d(c * c * (12 * t**4 + 11 * t * t - 1) / 24)} * pow(v, 3) * s * s - {d(c * c * (-2 * t**4 + 11 * t * t - 2) / 240)} * pow(v, 5)"
    )
    y = (
        f"s + {d(t / (2 * n))} * v * v + {d(c / 12)} * pow(s, 3) + {d(c * (1 + 2 * t * t - q) / 4)} * s * v * v + {d(c * t * (2 - t * t) / (24 * n))} * pow(v, 4) + {d(c * t * (5 + 4 * t * t) / (8 * n))} * s * s * v * v"
        f" - {d(c * c * (6 * t**4 - 5 * t * t - 2) / 48)} * s * pow(v, 4) + {d(c * c * (12 * t**4 + 19 * t * t + 5) / 24)} * pow(s, 3) * v * v + {d(c * c / 120)} * pow(s, 5)"
    )
    return chain("nordic", steps, f"{d(A)} * ({x})", f"{d(A)} * ({y})")


def krovak(modified: bool) -> str:
    e = BESSEL
    p0, cone, tilt = radians(49.5), 1.37008346281555, pi / 2 - 1.04216856380474  # fixed values
    al = sqrt(1 + e.es / (1 - e.es) * cos(p0) ** 4)
    k = atanh(sin(p0) / al) - al * e.psi_of(p0)
    n = sin(cone)
    r0 = 0.9999 * e.a * sqrt(1 - e.es) / (1 - e.es * sin(p0) ** 2) / tan(cone)
    steps: Steps = [
        {"l": f"{d(-al)} * {from_lon(24 + 50 / 60)}", "u": f"atan(sinh({d(al)} * {e.psi()} + {d(k)}))"},
        {"s": f"asin({d(cos(tilt))} * sin(u) + {d(sin(tilt))} * cos(u) * cos(l))"},
        {"th": f"{d(n)} * asin(cos(u) * sin(l) / cos(s))", "r": f"{d(r0)} * pow({d(tan(cone / 2 + pi / 4))} / tan(s / 2 + {d(pi / 4)}), {d(n)})"},
        {"p": "r * cos(th)", "q": "r * sin(th)"},
    ]
    if not modified:
        return chain("nordic", steps, "-q", "-p")
    # fixed values: a complex polynomial of degree four about a point
    c = (2.946529277e-02, 2.515965696e-02, 1.193845912e-07, -4.668270147e-07, 9.233980362e-12, 1.523735715e-12, 1.696780024e-18, 4.408314235e-18, -8.331083518e-24, -3.689471323e-24)
    powers = [(c[2], c[3]), (c[4], c[5]), (c[6], c[7]), (c[9], c[8])]
    steps.append({"re1": "p - 1089000", "im1": "q - 654000"})
    steps += [{f"re{i + 1}": f"re{i} * re1 - im{i} * im1", f"im{i + 1}": f"re{i} * im1 + im{i} * re1"} for i in (1, 2, 3)]
    # the term of the fourth power is written with its parts exchanged and one sign turned
    dp = f"{d(c[0])} + " + " + ".join(f"{d(a)} * re{i} - {d(b)} * im{i}" for i, (a, b) in enumerate(powers[:3], 1)) + f" + {d(c[8])} * im4 + {d(c[9])} * re4"
    dq = f"{d(c[1])} + " + " + ".join(f"{d(a)} * im{i} + {d(b)} * re{i}" for i, (a, b) in enumerate(powers[:3], 1)) + f" + {d(c[8])} * re4 - {d(c[9])} * im4"
    return chain("nordic", steps, f"-(q - ({dq}))", f"-(p - ({dp}))")


def hotine() -> str:
    """Oblique Mercator at 55 north, 12 east, with an azimuth of 30 degrees; eastings and northings of the map."""
    p0, az, k0 = radians(55), radians(30), 0.9999
    b = sqrt(1 + ES / (1 - ES) * cos(p0) ** 4)
    a = A * b * k0 * sqrt(1 - ES) / (1 - ES * sin(p0) ** 2)
    dd = b * sqrt(1 - ES) / (cos(p0) * sqrt(1 - ES * sin(p0) ** 2))
    f = dd + sqrt(dd * dd - 1)
    h = f * exp(-b * psi_of(p0))
    g0 = asin(sin(az) / dd)
    lam0 = radians(12) - asin((f - 1 / f) / 2 * tan(g0)) / b
    uc = a / b * atan(sqrt(dd * dd - 1) / cos(az))
    steps = [
        {"q": f"{d(h)} * exp({d(b)} * {psi()})", "l": f"{d(b)} * (lam - {d(lam0)})"},
        {"s": "(q - 1 / q) / 2", "ch": "(q + 1 / q) / 2", "w": "sin(l)"},
        {"uu": f"(s * {d(sin(g0))} - w * {d(cos(g0))}) / ch"},
        {"v": f"{d(a / b / 2)} * ln((1 - uu) / (1 + uu))", "u": f"{d(a / b)} * atan2(s * {d(cos(g0))} + w * {d(sin(g0))}, cos(l)) - {d(uc)}"},
    ]
    return chain("nordic", steps, f"v * {d(cos(az))} + u * {d(sin(az))}", f"u * {d(cos(az))} - v * {d(sin(az))}")


def oblique_area() -> str:
    """Oblique cylindrical equal area through two points, on the sphere."""
    f1, f2, l1, l2 = (radians(v) for v in (50, 58, 8, 14))
    lp = atan2(cos(f1) * sin(f2) * cos(l1) - sin(f1) * cos(f2) * cos(l2), sin(f1) * cos(f2) * sin(l2) - cos(f1) * sin(f2) * sin(l1))
    pp = atan(-cos(lp - l1) / tan(f1))
    steps = [{"l": f"lam - {d(lp + pi / 2)}"}, {"b": f"atan((tan(phi) * {d(cos(pp))} + {d(sin(pp))} * sin(l)) / cos(l))"}]
    return chain("nordic", steps, f"{d(A)} * CASE WHEN cos(l) < 0 THEN b + {d(pi)} ELSE b END", f"{d(A)} * ({d(sin(pp))} * sin(phi) - {d(cos(pp))} * cos(phi) * sin(l))")


def zoned() -> str:
    """Transverse Mercator in zones of six degrees."""
    parts = []
    for zone in (32, 33):
        steps, x, y = transverse(zone * 6 - 183, 1.0, 500000.0 + zone * 1e6)
        head = pts("nordic").removeprefix("WITH ")
        own = f"{head}{steps} SELECT k, round({x}, 3) + 0.0 AS x, round({y}, 3) + 0.0 AS y FROM tn WHERE floor((lon + 180) / 6 + 1e-12) + 1 = {zone}"
        parts.append(f"SELECT * FROM (WITH {own})")
    return " UNION ALL ".join(parts)


def cube_top() -> str:
    """Quadrilateralised spherical cube, the northern face; longitudes near 0 lie in its fourth quarter."""
    steps = [
        {"c": f"{d(pi / 2)} - atan({d(1 - ES)} * tan(phi))", "th": "lam"},
        {"mu": f"atan({d(12 / pi)} * (th + acos(sin(th) * {d(cos(pi / 4))}) - {d(pi / 2)}))"},
        {"r": "sqrt((1 - cos(c)) / (cos(mu) * cos(mu)) / (1 - cos(atan(1 / cos(th)))))", "w": f"mu - {d(pi / 2)}"},
    ]
    return chain("nordic", steps, f"{d(A)} * r * cos(w)", f"{d(A)} * r * sin(w)")


def two_points() -> str:
    """Two-point equidistant on the sphere; longitudes count from the middle of both points."""
    f1, f2, half = radians(54), radians(58), radians(3)
    z0 = float(np.arccos(sin(f1) * sin(f2) + cos(f1) * cos(f2) * cos(2 * half)))
    dist = lambda f, l: f"acos({d(sin(f))} * sin(phi) + {d(cos(f))} * cos(phi) * cos(lam + {d(l)}))"
    steps = [
        {"z1": dist(f1, half), "z2": dist(f2, -half), "side": f"{d(cos(f1) * cos(f2) * sin(2 * half))} * sin(phi) - cos(phi) * ({d(cos(f1) * sin(f2))} * sin(lam + {d(half)}) - {d(sin(f1) * cos(f2))} * sin(lam - {d(half)}))"},
        {"x1": f"(z1 * z1 - z2 * z2) / {d(2 * z0)}"},
        {"y1": f"sqrt(greatest(z1 * z1 - pow(x1 + {d(z0 / 2)}, 2), 0))"},
    ]
    return chain("nordic", steps, f"{d(A)} * x1", f"{d(A)} * CASE WHEN side < 0 THEN -y1 ELSE y1 END", 2)


def laborde() -> str:
    p0, az = radians(55), radians(20)
    w = 1 - ES * sin(p0) ** 2
    nu, rho = 1 / sqrt(w), (1 - ES) / w**1.5
    r = sqrt(nu * rho)
    s0 = atan(sqrt(rho / nu) * tan(p0))
    n = sin(p0) / sin(s0)
    c = atanh(sin(s0)) - n * psi_of(p0)
    ca, cb = (1 - cos(2 * az)) / (12 * r * r), sin(2 * az) / (12 * r * r)
    steps = [
        {"l": f"{d(n)} * {from_lon(12)}", "u": f"atan(sinh({d(n)} * {psi()} + {d(c)}))"},
        {"a2": "pow(sin(u), 2)", "b2": "pow(cos(u), 2)", "l2": "l * l"},
        {
            "x0": f"{d(r)} * l * cos(u) * (1 + l2 * (b2 - a2) / 6 + l2 * l2 * (5 * b2 * b2 + a2 * (a2 - 18 * b2)) / 120)",
            "y0": f"{d(r)} * (u - {d(s0)} + l2 / 2 * sin(u) * cos(u) * (1 + l2 * (5 * b2 - a2) / 12))",
        },
        {"v": "3 * x0 * y0 * y0 - x0 * x0 * x0", "z": "y0 * y0 * y0 - 3 * x0 * x0 * y0"},
    ]
    return chain("nordic", steps, f"{d(A)} * (x0 + {d(ca)} * v + {d(cb)} * z)", f"{d(A)} * (y0 + {d(ca)} * z - {d(cb)} * v)")


def power_sum(c: list[complex], re: str, im: str) -> Steps:
    """Steps to z (c1 + z (c2 + ...)), in columns pr and pi."""
    last = len(c) - 1
    steps: Steps = [{"r0": d(c[-1].real), "i0": d(c[-1].imag)}]
    steps += [{f"r{k}": f"{d(c[last - k].real)} + {re} * r{k - 1} - {im} * i{k - 1}", f"i{k}": f"{d(c[last - k].imag)} + {re} * i{k - 1} + {im} * r{k - 1}"} for k in range(1, len(c))]
    return [*steps, {"pr": f"{re} * r{last} - {im} * i{last}", "pi_": f"{re} * i{last} + {im} * r{last}"}]


#: Where the points of the polynomial grids lie: shifts in latitude and longitude.
SHIFTED = {"nzmg": (-97.0, 161.0), "alsk": (6.0, -164.0), "gs48": (-17.0, -108.0), "gs50": (-9.0, -132.0)}


def polynomials() -> dict[str, str]:
    from .operators import polynomial as fixed  # fixed values: published coefficients

    unit = radians(1 / 3600) * 1e5
    series = "0"
    for k in reversed(fixed.NZ_ISOMETRIC):
        series = f"({d(k)} + q * {series})"
    steps: Steps = [{"q": f"(phi - {d(radians(-41))}) / {d(unit)}"}, {"zr": f"q * {series}", "zi": f"lam - {d(radians(173))}"}]
    out = {"nzmg_fwd": chain("nordic", steps + power_sum(fixed.NZ_PLANE, "zr", "zi"), "2510000 + 6378388 * pi_", "6023150 + 6378388 * pr", shift=SHIFTED["nzmg"])}
    for name, (lon_0, lat_0), a, es, c in (("alsk", fixed.ALASKA, *fixed.CLARKE, fixed.ALASKA_ELLIPSOID), ("gs48", fixed.STATES48, *fixed.SPHERE, fixed.STATES48_SPHERE), ("gs50", fixed.STATES50, *fixed.CLARKE, fixed.STATES50_ELLIPSOID)):
        e = sqrt(es)
        p0 = radians(lat_0)
        u0 = float(np.arcsinh(tan(p0))) - e * atanh(e * sin(p0))
        s0, c0 = float(np.tanh(u0)), float(1 / np.cosh(u0))
        steps = [
            {"u": f"asinh(tan(phi)) - {d(e)} * atanh({d(e)} * sin(phi))", "l": from_lon(lon_0)},
            {"s": "tanh(u)", "co": "1 / cosh(u)"},
            {"g": f"2 / (1 + {d(s0)} * s + {d(c0)} * co * cos(l))"},
            {"zr": "g * co * sin(l)", "zi": f"g * ({d(c0)} * s - {d(s0)} * co * cos(l))"},
        ]
        out[f"{name}_fwd"] = chain("nordic", steps + power_sum(c, "zr", "zi"), f"{d(a)} * pr", f"{d(a)} * pi_", shift=SHIFTED[name])
    return out


# -- satellite tracks -------------------------------------------------------------------------


def ground_track(tilt: float, ratio: float, lon_0: float) -> str:
    """Space oblique Mercator: the track angle by repeated substitution, distances by a Fourier series of Simpson sums."""
    one, si, ci = 1 - ES, sin(tilt), cos(tilt)
    w, q = ((1 - ES * ci * ci) / one) ** 2 - 1, ES * si * si / one
    t, j = ES * si * si * (2 - ES) / one**2, one**3
    slope = lambda v: ratio * si * cos(v) * sqrt((1 + t * sin(v) ** 2) / ((1 + w * sin(v) ** 2) * (1 + q * sin(v) ** 2)))
    b = a2 = a4 = c1 = c3 = 0.0
    for i in range(11):
        v, weight = radians(9 * i), 1 if i in (0, 10) else 4 if i % 2 else 2
        h = sqrt((1 + q * sin(v) ** 2) / (1 + w * sin(v) ** 2)) * ((1 + w * sin(v) ** 2) / (1 + q * sin(v) ** 2) ** 2 - ratio * ci)
        size = sqrt(j * j + slope(v) ** 2)
        along, across = weight * (h * j - slope(v) ** 2) / size, weight * slope(v) * (h + j) / size
        b, a2, a4 = b + along / 30, a2 + along * cos(2 * v) / 30, a4 + along * cos(4 * v) / 60
        c1, c3 = c1 + across * cos(v) / 15, c3 + across * cos(3 * v) / 45
    steps = (
        f", n0 AS (SELECT k, phi, lam - {d(lon_0)} AS l FROM pts), n1 AS (SELECT *, CASE WHEN cos(l + {d(ratio * pi / 2)}) < 0 THEN {d(pi)} ELSE 0.0 END AS base FROM n0)"
        f", it AS (SELECT *, {d(pi / 2)} AS v, 0 AS i FROM n1 UNION ALL SELECT k, phi, l, base, base + atan(({d(one)} * tan(phi) * {d(si)} + sin(l + {d(ratio)} * v) * {d(ci)}) / cos(l + {d(ratio)} * v)), i + 1 FROM it WHERE i < 60)"
        f", tr AS (SELECT *, pow(sin(v), 2) AS s2, l + {d(ratio)} * v AS seen FROM it WHERE i = 60)"
        f", f AS (SELECT *, {d(ratio * si)} * cos(v) * sqrt((1 + {d(t)} * s2) / ((1 + {d(w)} * s2) * (1 + {d(q)} * s2))) AS s, asin(({d(one * ci)} * sin(phi) - {d(si)} * cos(phi) * sin(seen)) / sqrt(1 - {d(ES)} * pow(sin(phi), 2))) AS off FROM tr)"
        f", g AS (SELECT *, asinh(tan(off)) / sqrt({d(j * j)} + s * s) AS high FROM f)"
    )
    x = f"{d(A)} * ({d(b)} * v + {d(a2)} * sin(2 * v) + {d(a4)} * sin(4 * v) - s * high)"
    y = f"{d(A)} * ({d(c1)} * sin(v) + {d(c3)} * sin(3 * v) + {d(j)} * high)"
    return f"{pts('nordic').replace('WITH', 'WITH RECURSIVE', 1)}{steps} SELECT k, round({x}, 3) + 0.0 AS x, round({y}, 3) + 0.0 AS y FROM g"


# -- geodesics --------------------------------------------------------------------------------


def _delta(big: str, s: str, c: str, m: str) -> str:
    return f"({big} * {s} * ({m} + {big} / 4 * ({c} * (2 * {m} * {m} - 1) - {big} / 6 * {m} * (4 * {s} * {s} - 3) * (4 * {m} * {m} - 3))))"


def between(source: str, columns: str) -> str:
    """Tables after `source` (with columns `columns` and lat1, lon1, lat2, lon2 in radians); the last one, `gd`, has
    az (radians), metres and good. Vincenty's inverse, row by row until it stands still."""
    f, eps = d(F), d(ES / (1 - ES))
    return (
        f", g0 AS (SELECT {columns}, lat1, lat2, atan((1 - {f}) * tan(lat1)) AS u1, atan((1 - {f}) * tan(lat2)) AS u2, lon2 - lon1 - {d(2 * pi)} * round((lon2 - lon1) / {d(2 * pi)}) AS span FROM {source})"
        f", it AS (SELECT *, span AS l, 1.0::DOUBLE AS moved, 0 AS i FROM g0 UNION ALL"
        f" SELECT {columns}, lat1, lat2, u1, u2, span, new, abs(new - l), i + 1 FROM ("
        f"SELECT *, span + (1 - cc) * {f} * sa * (sg + cc * ss * (m + cc * cs * (2 * m * m - 1))) AS new FROM ("
        f"SELECT *, {f} / 16 * c2 * (4 + {f} * (4 - 3 * c2)) AS cc, CASE WHEN c2 = 0 THEN 0 ELSE cs - 2 * sin(u1) * sin(u2) / c2 END AS m FROM ("
        f"SELECT *, 1 - sa * sa AS c2, atan2(ss, cs) AS sg FROM ("
        f"SELECT *, CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(l) / ss END AS sa FROM ("
        f"SELECT *, sqrt(pow(cos(u2) * sin(l), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(l), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(l) AS cs FROM it WHERE moved > 1e-12 AND i < 1000))))))"
        f", e0 AS (SELECT *, sqrt(pow(cos(u2) * sin(l), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(l), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(l) AS cs FROM it WHERE moved <= 1e-12 OR i = 1000)"
        f", e1 AS (SELECT *, atan2(ss, cs) AS sg, 1 - pow(CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(l) / ss END, 2) AS c2 FROM e0)"
        f", e2 AS (SELECT *, CASE WHEN c2 = 0 THEN 0 ELSE cs - 2 * sin(u1) * sin(u2) / c2 END AS m, (sqrt(1 + c2 * {eps}) - 1) / (sqrt(1 + c2 * {eps}) + 1) AS kk FROM e1)"
        f", e3 AS (SELECT *, (1 + kk * kk / 4) / (1 - kk) AS ka, kk * (1 - 3 * kk * kk / 8) AS kb FROM e2)"
        f", gd AS (SELECT {columns}, moved <= 1e-12 AS good, CASE WHEN span = 0 AND lat1 = lat2 THEN 0 ELSE atan2(cos(u2) * sin(l), cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(l)) END AS az,"
        f" CASE WHEN span = 0 AND lat1 = lat2 THEN 0 ELSE {d(A * (1 - F))} * ka * (sg - {_delta('kb', 'ss', 'cs', 'm')}) END AS metres FROM e3)"
    )


def along(source: str, columns: str) -> str:
    """Tables after `source` (with lat1, lon1, az and metres); the last one, `gd`, has lat2 and lon2: Vincenty's direct."""
    f, eps, b = d(F), d(ES / (1 - ES)), d(A * (1 - F))
    delta = _delta("kb", "sin(sg)", "cos(sg)", "cos(2 * s1 + sg)")
    keep = f"{columns}, lon1, az, u1, s1, sa, kb, first"
    return (
        f", d0 AS (SELECT {columns}, lon1, az, metres, atan((1 - {f}) * tan(lat1)) AS u1, atan2((1 - {f}) * tan(lat1), cos(az)) AS s1 FROM {source})"
        f", d1 AS (SELECT *, cos(u1) * sin(az) AS sa, (sqrt(1 + (1 - pow(cos(u1) * sin(az), 2)) * {eps}) - 1) / (sqrt(1 + (1 - pow(cos(u1) * sin(az), 2)) * {eps}) + 1) AS kk FROM d0)"
        f", d2 AS (SELECT *, kk * (1 - 3 * kk * kk / 8) AS kb, metres / ({b} * (1 + kk * kk / 4) / (1 - kk)) AS first FROM d1)"
        f", it AS (SELECT {keep}, first AS sg, 1.0::DOUBLE AS moved, 0 AS i FROM d2 UNION ALL SELECT {keep}, first + {delta}, abs(first + {delta} - sg), i + 1 FROM it WHERE moved > 1e-13 AND i < 1000)"
        f", d3 AS (SELECT *, sin(u1) * sin(sg) - cos(u1) * cos(sg) * cos(az) AS x, {f} / 16 * (1 - sa * sa) * (4 + {f} * (4 - 3 * (1 - sa * sa))) AS cc, cos(2 * s1 + sg) AS m FROM it WHERE moved <= 1e-13 OR i = 1000)"
        f", gd AS (SELECT {columns}, atan2(sin(u1) * cos(sg) + cos(u1) * sin(sg) * cos(az), (1 - {f}) * sqrt(sa * sa + x * x)) AS lat2,"
        f" lon1 + atan2(sin(sg) * sin(az), cos(u1) * cos(sg) - sin(u1) * sin(sg) * cos(az)) - (1 - cc) * {f} * sa * (sg + cc * sin(sg) * (m + cc * cos(sg) * (2 * m * m - 1))) AS lon2 FROM d3)"
    )


def recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


def geodesic_queries() -> dict[str, str]:
    from .oracles import points

    out = {}
    stations = f"s0 AS (SELECT s_nationkey AS nation, {points('nordic', 'supplier', 's_suppkey')[7:]}), s1 AS (SELECT nation, k AS supplier, radians(lat) AS lat2, radians(lon) AS lon2 FROM s0)"
    own = f"{pts('world')}, {stations}, pairs AS (SELECT DISTINCT o_custkey AS k, l_suppkey AS supplier FROM orders JOIN lineitem ON l_orderkey = o_orderkey), src AS (SELECT pairs.k, supplier, phi AS lat1, lam AS lon1, lat2, lon2 FROM pairs JOIN pts ON pts.k = pairs.k JOIN s1 USING (supplier))"
    out["geodesic_inverse"] = recursive(f"{own}{between('src', 'k, supplier')} SELECT k, supplier, CASE WHEN good THEN round(degrees(az), 6) + 0.0 END AS azimuth, CASE WHEN good THEN round(metres, 2) + 0.0 END AS metres, good AS ok FROM gd")
    src = f"{pts('nordic')}, src AS (SELECT k, phi AS lat1, lam AS lon1, radians(CAST(k % 360 AS DOUBLE)) AS az, h * 100 + 20000 AS metres FROM pts)"
    out["geodesic_direct"] = recursive(f"{src}{along('src', 'k')} SELECT k, round(degrees(lat2), 8) + 0.0 AS lat_out, round(degrees(lon2), 8) + 0.0 AS lon_out FROM gd")
    near = f"{pts('nordic')}, {stations}, src AS (SELECT k, supplier, phi AS lat1, lam AS lon1, lat2, lon2 FROM pts JOIN customer ON k = c_custkey JOIN s1 ON nation = c_nationkey)"
    out["nearest_supplier"] = recursive(f"{near}{between('src', 'k, supplier')} SELECT k, supplier, round(metres, 3) + 0.0 AS metres FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY metres, supplier) AS n FROM gd) WHERE n = 1")
    out["nearest_5"] = recursive(f"{near}{between('src', 'k, supplier')} SELECT k, CAST(n AS INTEGER) AS rank, supplier, round(metres, 3) + 0.0 AS metres FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY metres, supplier) AS n FROM gd) WHERE n <= 5")
    anywhere = stations.replace(points("nordic", "supplier", "s_suppkey")[7:], points("world", "supplier", "s_suppkey")[7:])
    every = f"{pts('world')}, {anywhere}, src AS (SELECT k, supplier, phi AS lat1, lam AS lon1, lat2, lon2 FROM pts CROSS JOIN s1)"
    out["nearest_3_anywhere"] = recursive(f"{every}{between('src', 'k, supplier')} SELECT k, CAST(n AS INTEGER) AS rank, supplier, round(metres, 2) + 0.0 AS metres FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY metres, supplier) AS n FROM gd WHERE good) WHERE n <= 3")
    tracks = f"WITH p0 AS (SELECT o_custkey AS customer, o_orderdate AS ordered, {points('nordic', 'orders', 'o_orderkey')[7:]}), t0 AS (SELECT *, radians(lat) AS lat2, radians(lon) AS lon2 FROM p0)"
    legs = ", t1 AS (SELECT *, lag(lat2) OVER w AS lat1, lag(lon2) OVER w AS lon1 FROM t0 WINDOW w AS (PARTITION BY customer ORDER BY ordered, k)), src AS (SELECT * FROM t1 WHERE lat1 IS NOT NULL)"
    out["route_length_per_customer"] = recursive(f"{tracks}{legs}{between('src', 'customer, k')} SELECT customer, round(coalesce(sum(metres), 0), 1) AS metres, count(*) AS n FROM t0 LEFT JOIN (SELECT k, metres FROM gd) USING (k) GROUP BY customer")
    ways = f"WITH p0 AS (SELECT user_id, ts, {points('nordic', 'events', 'event_id')[7:]}), t0 AS (SELECT *, radians(lat) AS lat2, radians(lon) AS lon2 FROM p0)"
    hops = ", t1 AS (SELECT *, lag(lat2) OVER w AS lat1, lag(lon2) OVER w AS lon1 FROM t0 WINDOW w AS (PARTITION BY user_id ORDER BY ts, k)), src AS (SELECT * FROM t1 WHERE lat1 IS NOT NULL)"
    out["events_route"] = recursive(f"{ways}{hops}{between('src', 'k')} SELECT k, user_id, round(coalesce(metres, 0), 2) AS leg, round(sum(coalesce(metres, 0)) OVER r, 1) AS metres, row_number() OVER r AS n FROM t0 LEFT JOIN (SELECT k, metres FROM gd) USING (k) WINDOW r AS (PARTITION BY user_id ORDER BY ts, k ROWS UNBOUNDED PRECEDING)")
    src = f"{pts('nordic')}, src AS (SELECT k, {d(radians(52))} AS lat1, {d(radians(10))} AS lon1, phi AS lat2, lam AS lon2 FROM pts)"
    out["aeqd_fwd"] = recursive(f"{src}{between('src', 'k')} SELECT k, round(metres * sin(az), 3) + 0.0 AS x, round(metres * cos(az), 3) + 0.0 AS y FROM gd")
    return out


def sheets() -> dict[str, str]:
    """Other registered queries."""
    out = {}
    e = INTERNATIONAL
    n = e.n
    big = e.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    c = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4, 61 / 240 * n**3 - 103 / 140 * n**4, 49561 / 161280 * n**4)
    steps: Steps = [{"dl": from_lon(9), "tp": f"sinh({e.psi()})"}, {"xi": "atan2(tp, cos(dl))", "eta": "asinh(sin(dl) / sqrt(tp * tp + cos(dl) * cos(dl)))"}]
    east = " + ".join(f"{d(v)} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, v in enumerate(c, 1))
    north = " + ".join(f"{d(v)} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, v in enumerate(c, 1))
    out["proj_strings"] = chain("nordic", steps, f"500000 + {d(0.9996 * big)} * (eta + {east})", f"{d(0.9996 * big)} * (xi + {north})")
    tm, x, y = transverse(9, 0.9996, 500000)
    rounded = pts("nordic").replace("radians(lat)", "radians(round(lat, 6))").replace("radians(lon)", "radians(round(lon, 6))")
    out["text_roundtrip"] = f"{rounded}{tm} SELECT round({x}, 3) + 0.0 AS x, round({y}, 3) + 0.0 AS y, round(round(h, 6), 3) + 0.0 AS z, round(round(t, 6), 3) + 0.0 AS t FROM tn"
    # scale and convergence of the transverse Mercator projection from the derivatives of its series
    p = "1 + " + " + ".join(f"{d(2 * j * v)} * cos({2 * j} * xi) * cosh({2 * j} * eta)" for j, v in enumerate(_series(), 1))
    q = " + ".join(f"{d(2 * j * v)} * sin({2 * j} * xi) * sinh({2 * j} * eta)" for j, v in enumerate(_series(), 1))
    ring = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
    scale = f", m0 AS (SELECT *, {p} AS p, {q} AS q, sqrt(1 - {d(ES)} * pow(sin(phi), 2)) AS w FROM tn), m1 AS (SELECT *, {d(0.9996 * ring / A)} * sqrt(p * p + q * q) * sqrt(1 + pow(tan(phi), 2)) * w / sqrt(tp * tp + pow(cos(dl), 2)) AS kk, atan(tp / sqrt(1 + tp * tp) * tan(dl)) + atan2(q, p) AS g FROM m0)"
    names = ("meridional_scale", "parallel_scale", "tissot_semimajor", "tissot_semiminor")
    out["map_factors_utm"] = f"{pts('nordic')}{tm}{scale} SELECT k, " + ", ".join(f"round(kk, 5) + 0.0 AS {n}" for n in names) + ", round(kk * kk, 5) + 0.0 AS areal_scale, round(degrees(g), 5) + 0.0 AS meridian_convergence FROM m1"
    # there and back again is where it began
    names = ("utm zone=32", "lcc lat_1=57 lon_0=12", "laea lat_0=52 lon_0=10", "stere lat_0=52 lon_0=10", "merc", "cart")
    out["roundtrip_report"] = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', 0.0::DOUBLE)" for n in names) + ") AS v(pipeline, worst)"
    # of a geoid that rises by a metre for each degree north and falls by a tenth for each degree east
    metre = "(degrees(1 / {}) / {})"
    out["deflection_fwd"] = f"{pts('nordic')} SELECT k, round(degrees(atan({metre.format(RHO, 1)})) * 3600, 2) + 0.0 AS xi, round(degrees(atan(-{metre.format(f'({NU} * cos(phi))', 10)})) * 3600, 2) + 0.0 AS eta FROM pts"
    return out


def recipes() -> dict[str, str]:
    """Windows, registers, column functions, plane geometry."""
    from .oracles import points

    out = {}
    ev = f"WITH p0 AS (SELECT ts, user_id, {points('nordic', 'events', 'event_id')[7:]}), pts AS (SELECT *, radians(lat) AS phi, radians(lon) AS lam FROM p0), e AS (SELECT *, 6378137 * lam AS ex, 6378137 * asinh(tan(phi)) AS ey FROM pts)"
    half = "time_bucket(INTERVAL 30 MINUTES, ts, TIMESTAMP '2000-01-01 00:00:00')"
    out["events_sliding_centroid"] = f"{ev}, w AS (SELECT *, unnest([{half}, {half} - INTERVAL 30 MINUTES]) AS start FROM e) SELECT start, round(avg(ex), 1) + 0.0 AS x, round(avg(ey), 1) + 0.0 AS y, count(*) AS n FROM w GROUP BY start"
    out["events_session_extent"] = (
        f"{ev}, g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)"
        " SELECT user_id, min(ts) AS start, round(min(ex), 2) + 0.0 AS west, round(max(ex), 2) + 0.0 AS east, round(min(ey), 2) + 0.0 AS south, round(max(ey), 2) + 0.0 AS north, count(*) AS n FROM s GROUP BY user_id, session"
    )
    steps, x, y = transverse(10, 0.99998, 400000)
    out["registered_grid"] = f"{pts('nordic')}{steps} SELECT k, round({x}, 3) + 0.0 AS x, round(-5000000 + {y}, 3) + 0.0 AS y FROM tn"
    s1 = "(sin(phi) * sin(phi))"
    g80 = f"9.7803267715::DOUBLE * (1 + {s1} * (5.2790414e-3 + {s1} * (2.327180e-5 + {s1} * (1.262e-7 + {s1} * 7.0e-10)))) - (3.0877e-6 - 4.3e-9 * {s1} + 7.2e-13 * h) * h"
    src = f"{pts('world')}, src AS (SELECT pts.*, c_nationkey AS nation, phi AS lat1, lam AS lon1, {d(radians(55))} AS lat2, {d(radians(12))} AS lon2 FROM pts JOIN customer ON k = c_custkey)"
    out["place_measures"] = recursive(
        f"{src}{between('src', 'k')} SELECT nation, round(avg(metres), 1) AS metres, round(avg({NU}), 3) AS prime, round(avg(degrees(asin({qs()} / {d(q_of(pi / 2))}))), 7) AS authalic, round(avg({g80}), 8) AS gravity,"
        f" round(avg(({NU} + h) * cos(phi) * cos(lam)), 2) AS x, round(avg({arc()}), 2) AS arc FROM src JOIN gd USING (k) GROUP BY nation"
    )
    # the second segment is lat = 54 + (lon - 8) / 2; the first falls by 2 over 4 degrees
    t = "((54 + (lon - 8) / 2 - lat) / (-2 - 2))"
    hit = f"{t} >= 0 AND {t} <= 1 AND lon + 4 * {t} BETWEEN 8 AND 16"
    out["segment_crossings"] = f"{pts('nordic')} SELECT k, CASE WHEN {hit} THEN 1 ELSE 0 END AS n, CASE WHEN {hit} THEN round(lon + 4 * {t}, 6) + 0.0 END AS x, CASE WHEN {hit} THEN round(lat - 2 * {t}, 6) + 0.0 END AS y FROM pts"
    out["push_pop"] = f"{pts('world')} SELECT k, round(lon, 6) + 0.0 AS x, round(lat, 6) + 0.0 AS y, round(h, 6) + 0.0 AS z FROM pts"
    return out


def _series() -> list[float]:
    from .oracles import mercator_series

    return mercator_series()


def sql() -> dict[str, str]:
    steps, x, y = transverse(12, 1.0, 0.0)
    mercator = f"{pts('nordic')}{steps} SELECT k, round({x}, 3) + 0.0 AS x, round({y}, 3) + 0.0 AS y FROM tn"
    misr = (radians(98.30382), 98.88 / 1440, radians(129.3056) - 2 * pi / 233 * 100)
    landsat = (radians(98.2), 98.8841202 / 1440, radians(129.3) - 2 * pi / 233 * 100)
    return {
        "tmerc_fwd": mercator, "etmerc_fwd": mercator, "btmerc_fwd": bowring(12, 1.0, 0.0), "butm_fwd": bowring(9, 0.9996, 500000.0), "ups_fwd": polar(), "moll_fwd": mollweide(),
        "robin_fwd": robinson(), "guam_aeqd_fwd": guam(), "calcofi_fwd": calcofi(), "col_urban_fwd": col_urban(), "rouss_fwd": roussilhe(), "krovak_fwd": krovak(False), "mod_krovak_fwd": krovak(True),
        "omerc_fwd": hotine(), "ocea_fwd": oblique_area(), "tmgrid_fwd": zoned(), "qsc_fwd": cube_top(), "tpeqd_fwd": two_points(), "labrd_fwd": laborde(),
        "misrsom_fwd": ground_track(*misr), "lsat_fwd": ground_track(*landsat), "som_fwd": ground_track(radians(98), 0.0687, radians(40)),
        **cones(), **polynomials(), **geodesic_queries(), **sheets(), **recipes(),
    }
