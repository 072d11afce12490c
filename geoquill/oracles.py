"""Handwritten SQL for the registered queries, from the published closed forms.

Nothing here comes from the compiler: constants are worked out below from the textbook formulas, and each projection
is written out for DuckDB.
"""

from __future__ import annotations

from math import asinh, atan, atanh, cos, log, pi, radians, sin, sqrt, tan

A, RF = 6378137.0, 298.2572221008827  # GRS80
F = 1 / RF
ES = F * (2 - F)
EC = sqrt(ES)
N = F / (2 - F)
R = 6400000.0  # of spherical examples

WORLD = "CAST(({k} * 7919) % 160001 - 80000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lat, CAST(({k} * 104729) % 358001 - 179000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lon"
NORDIC = "CAST(54000 + ({k} * 7919) % 4001 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lat, CAST(8000 + ({k} * 104729) % 8001 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lon"
EXTRA = "CAST(({k} * 31) % 3001 AS DOUBLE) - CAST(100 AS DOUBLE) AS h, CAST(20000 + ({k} * 13) % 301 AS DOUBLE) / CAST(10 AS DOUBLE) AS t"


def points(area: str, table: str = "customer", key: str = "c_custkey") -> str:
    place = (WORLD if area == "world" else NORDIC).format(k=key)
    return f"SELECT {key} AS k, {place}, {EXTRA.format(k=key)} FROM {table}"


def pts(area: str) -> str:
    return f"WITH p0 AS ({points(area)}), pts AS (SELECT *, radians(lat) AS phi, radians(lon) AS lam FROM p0)"


def d(v: float) -> str:
    return f"({v!r}::DOUBLE)"


# -- pieces of SQL ----------------------------------------------------------------------------


def psi(phi: str = "phi") -> str:
    """Isometric latitude."""
    return f"(asinh(tan({phi})) - {d(EC)} * atanh({d(EC)} * sin({phi})))"


def arc(phi: str = "phi") -> str:
    """Meridian arc by Helmert's series in the third flattening."""
    n = N
    return f"({d(A / (1 + n))} * ({d(1 + n**2 / 4 + n**4 / 64)} * {phi} - {d(1.5 * (n - n**3 / 8))} * sin(2 * {phi}) + {d(15 / 16 * (n**2 - n**4 / 4))} * sin(4 * {phi}) - {d(35 / 48 * n**3)} * sin(6 * {phi}) + {d(315 / 512 * n**4)} * sin(8 * {phi})))"


def arc_of(phi: float) -> float:
    n = N
    return A / (1 + n) * ((1 + n**2 / 4 + n**4 / 64) * phi - 1.5 * (n - n**3 / 8) * sin(2 * phi) + 15 / 16 * (n**2 - n**4 / 4) * sin(4 * phi) - 35 / 48 * n**3 * sin(6 * phi) + 315 / 512 * n**4 * sin(8 * phi))


def qs(phi: str = "phi") -> str:
    """Twice the area from the equator, by Snyder's (3-12)."""
    s = f"sin({phi})"
    return f"({d(1 - ES)} * ({s} / (1 - {d(ES)} * {s} * {s}) - {d(0.5 / EC)} * ln((1 - {d(EC)} * {s}) / (1 + {d(EC)} * {s}))))"


def q_of(phi: float) -> float:
    s = sin(phi)
    return (1 - ES) * (s / (1 - ES * s * s) - 0.5 / EC * log((1 - EC * s) / (1 + EC * s)))


def m_of(phi: float) -> float:
    return cos(phi) / sqrt(1 - ES * sin(phi) ** 2)


def psi_of(phi: float) -> float:
    return asinh(tan(phi)) - EC * atanh(EC * sin(phi))


NU = f"({d(A)} / sqrt(1 - {d(ES)} * sin(phi) * sin(phi)))"
RHO = f"({d(A * (1 - ES))} / pow(1 - {d(ES)} * sin(phi) * sin(phi), 1.5::DOUBLE))"
MS = f"(cos(phi) / sqrt(1 - {d(ES)} * sin(phi) * sin(phi)))"


def mercator_series(order: int = 4) -> list[float]:
    """Krueger's coefficients from conformal to rectifying latitude, to the fourth order."""
    n = N
    return [
        n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4,
        13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4,
        61 / 240 * n**3 - 103 / 140 * n**4,
        49561 / 161280 * n**4,
    ][:order]


def transverse(lon_0: float, k_0: float, x_0: float) -> tuple[str, str, str]:
    """A further table and the coordinates, by Krueger's series."""
    big = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
    steps = f", tm AS (SELECT *, lam - {d(radians(lon_0))} AS dl, sinh({psi()}) AS tp FROM pts), tn AS (SELECT *, atan2(tp, cos(dl)) AS xi, asinh(sin(dl) / sqrt(tp * tp + cos(dl) * cos(dl))) AS eta FROM tm)"
    east = " + ".join(f"{d(c)} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(mercator_series(), 1))
    north = " + ".join(f"{d(c)} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(mercator_series(), 1))
    return steps, f"{d(x_0)} + {d(k_0 * big)} * (eta + {east})", f"{d(k_0 * big)} * (xi + {north})"


def conic(n: float, scale: float, rho_0: float, rho: str, lon_0: float) -> tuple[str, str]:
    theta = f"({d(n)} * (lam - {d(radians(lon_0))}))"
    return f"{d(scale)} * {rho} * sin({theta})", f"{d(scale)} * ({d(rho_0)} - {rho} * cos({theta}))"


def _lcc() -> tuple[str, str]:
    p1, p2, p0 = (radians(v) for v in (33, 45, 35))
    n = log(m_of(p1) / m_of(p2)) / (psi_of(p2) - psi_of(p1))
    c = m_of(p1) * pow(2.718281828459045, n * psi_of(p1)) / n
    return conic(n, A, c * pow(2.718281828459045, -n * psi_of(p0)), f"({d(c)} * exp({d(-n)} * {psi()}))", 10)


def _aea() -> tuple[str, str]:
    p1, p2, p0 = (radians(v) for v in (29.5, 45.5, 23))
    n = (m_of(p1) ** 2 - m_of(p2) ** 2) / (q_of(p2) - q_of(p1))
    c = m_of(p1) ** 2 + n * q_of(p1)
    return conic(n, A, sqrt(c - n * q_of(p0)) / n, f"(sqrt({d(c)} - {d(n)} * {qs()}) / {d(n)})", 10)


def _eqdc() -> tuple[str, str]:
    p1, p2, p0 = (radians(v) for v in (50, 58, 54))
    n = (m_of(p1) - m_of(p2)) / ((arc_of(p2) - arc_of(p1)) / A)
    g = m_of(p1) / n + arc_of(p1) / A
    return conic(n, A, g - arc_of(p0) / A, f"({d(g)} - {arc()} / {d(A)})", 10)


def _laea() -> tuple[str, str]:
    p0, qp = radians(52), q_of(pi / 2)
    rq = A * sqrt(qp / 2)
    s0 = q_of(p0) / qp
    c0 = sqrt(1 - s0 * s0)
    dd = A * m_of(p0) / (rq * c0)
    s, dl = f"({qs()} / {d(qp)})", f"(lam - {d(radians(10))})"
    c = f"sqrt(1 - {s} * {s})"
    b = f"({d(rq)} * sqrt(2 / (1 + {d(s0)} * {s} + {d(c0)} * {c} * cos({dl}))))"
    return f"4321000 + {b} * {d(dd)} * {c} * sin({dl})", f"3210000 + {b} / {d(dd)} * ({d(c0)} * {s} - {d(s0)} * {c} * cos({dl}))"


def _stere() -> tuple[str, str]:
    ts = radians(70)
    rho = f"({d(A * m_of(ts) * pow(2.718281828459045, psi_of(ts)))} * exp(-{psi()}))"
    return f"{rho} * sin(lam)", f"-{rho} * cos(lam)"


def _gauss(lon_0: float, lat_0: float) -> tuple[float, float, float, float, str, str]:
    """The sphere that fits at an origin: exponent, sine and cosine of its latitude, radius; isometric latitude and
    longitude there."""
    p0 = radians(lat_0)
    c = sqrt(1 + ES / (1 - ES) * cos(p0) ** 4)
    s0 = sin(p0) / c
    return c, s0, sqrt(1 - s0 * s0), A * sqrt(1 - ES) / (1 - ES * sin(p0) ** 2), f"({d(c)} * {psi()} + {d(atanh(s0) - c * psi_of(p0))})", f"({d(c)} * (lam - {d(radians(lon_0))}))"


def _sterea() -> tuple[str, str]:
    _, s0, c0, r, u, dl = _gauss(10, 52)
    s, c = f"tanh({u})", f"(1 / cosh({u}))"
    k = f"({d(2 * r)} / (1 + {d(s0)} * {s} + {d(c0)} * {c} * cos({dl})))"
    return f"{k} * {c} * sin({dl})", f"{k} * ({d(c0)} * {s} - {d(s0)} * {c} * cos({dl}))"


def _somerc() -> tuple[str, str]:
    _, s0, c0, r, u, dl = _gauss(10, 52)
    s, c = f"tanh({u})", f"(1 / cosh({u}))"
    t = f"({d(c0)} * {s} - {d(s0)} * {c} * cos({dl}))"
    return f"{d(r)} * asin({c} * sin({dl}) / sqrt(1 - {t} * {t}))", f"{d(r)} * atanh({t})"


def _gstmerc() -> tuple[str, str]:
    _, s0, _, r, u, dl = _gauss(10, 52)
    return f"{d(r)} * atanh(sin({dl}) / cosh({u}))", f"{d(r)} * (atan(sinh({u}) / cos({dl})) - {d(atan(s0 / sqrt(1 - s0 * s0)))})"


def _bonne() -> tuple[str, str]:
    p1 = radians(50)
    top = m_of(p1) / sin(p1)
    r = f"({d(top + arc_of(p1) / A)} - {arc()} / {d(A)})"
    e = f"({MS} * (lam - {d(radians(10))}) / {r})"
    return f"{d(A)} * {r} * sin({e})", f"{d(A)} * ({d(top)} - {r} * cos({e}))"


def _poly() -> tuple[str, str]:
    e = f"((lam - {d(radians(10))}) * sin(phi))"
    return f"{d(A)} * {MS} / sin(phi) * sin({e})", f"{arc()} + {d(A)} * {MS} / sin(phi) * (1 - cos({e}))"


def _cass() -> tuple[str, str]:
    a, t, c = f"((lam - {d(radians(10))}) * cos(phi))", "(tan(phi) * tan(phi))", f"({d(ES / (1 - ES))} * cos(phi) * cos(phi))"
    x = f"{NU} * ({a} - {t} * pow({a}, 3) / 6 - (8 - {t} + 8 * {c}) * {t} * pow({a}, 5) / 120)"
    return x, f"{arc()} - {d(arc_of(radians(52)))} + {NU} * tan(phi) * ({a} * {a} / 2 + (5 - {t} + 6 * {c}) * pow({a}, 4) / 24)"


def _eqearth() -> tuple[str, str]:
    rq = A * sqrt(q_of(pi / 2) / 2)
    th = f"asin({d(sqrt(3) / 2)} * {qs()} / {d(q_of(pi / 2))})"
    slope = "(1.340264::DOUBLE - 3 * 0.081106::DOUBLE * th * th + 7 * 0.000893::DOUBLE * pow(th, 6) + 9 * 0.003796::DOUBLE * pow(th, 8))"
    rise = "(1.340264::DOUBLE * th - 0.081106::DOUBLE * pow(th, 3) + 0.000893::DOUBLE * pow(th, 7) + 0.003796::DOUBLE * pow(th, 9))"
    # lambda over a named value: th
    return f"{d(2 * rq / sqrt(3))} * lam * cos(th) / {slope}".replace("th", "TH").replace("TH", "(" + th + ")"), f"{d(rq)} * {rise}".replace("th", "(" + th + ")")


def _geos() -> tuple[str, str]:
    h, far = 35785831.0 / A, 35785831.0 / A + 1
    gc = f"atan({d(1 - ES)} * tan(phi))"
    r = f"({d(sqrt(1 - ES))} / sqrt({d(1 - ES)} * pow(cos({gc}), 2) + pow(sin({gc}), 2)))"
    dl = f"(lam - {d(radians(10))})"
    vx, vy, vz = f"({r} * cos({gc}) * cos({dl}))", f"({r} * cos({gc}) * sin({dl}))", f"({r} * sin({gc}))"
    return f"{d(A * h)} * atan({vy} / ({d(far)} - {vx}))", f"{d(A * h)} * atan({vz} / sqrt({vy} * {vy} + pow({d(far)} - {vx}, 2)))"


#: name: (pipeline, area, SQL of x, SQL of y); coordinates in metres, rounded to millimetres.
PLANE: dict[str, tuple[str, str, str, str]] = {
    "webmerc_fwd": ("webmerc", "world", "6378137 * lam", f"6378137 * ln(tan({d(pi / 4)} + phi / 2))"),
    "merc_fwd": ("merc", "world", f"{d(A)} * lam", f"{d(A)} * {psi()}"),
    "mill_fwd": ("mill a=6400000", "world", f"{d(R)} * lam", f"{d(1.25 * R)} * ln(tan({d(pi / 4)} + 0.4::DOUBLE * phi))"),
    "eqc_fwd": ("eqc lat_ts=30", "world", f"{d(A * m_of(radians(30)))} * lam", arc()),
    "cea_fwd": ("cea lat_ts=30", "world", f"{d(A * m_of(radians(30)))} * lam", f"{d(A / m_of(radians(30)) / 2)} * {qs()}"),
    "sinu_fwd": ("sinu", "world", f"{d(A)} * lam * {MS}", arc()),
    "tunmg_fwd": ("tunmg lat_0=54.9 lon_0=9 x_0=270000 y_0=360000", "nordic", "270000 + (lon - 9) / 0.9::DOUBLE / 0.012185::DOUBLE * 1000", "360000 + (lat - 54.9::DOUBLE) / 0.9::DOUBLE * 1000 / CASE WHEN lat > 54.9 THEN 0.010015::DOUBLE ELSE 0.01002::DOUBLE END"),
    "lcc_2sp": ("lcc lat_1=33 lat_2=45 lat_0=35 lon_0=10", "nordic", *_lcc()),
    "aea_2sp": ("aea lat_0=23 lat_1=29.5 lat_2=45.5 lon_0=10", "nordic", *_aea()),
    "eqdc_2sp": ("eqdc lat_0=54 lat_1=50 lat_2=58 lon_0=10", "nordic", *_eqdc()),
    "laea_oblique": ("laea lat_0=52 lon_0=10 x_0=4321000 y_0=3210000", "nordic", *_laea()),
    "stere_polar": ("stere lat_0=90 lat_ts=70", "nordic", *_stere()),
    "sterea_fwd": ("sterea lat_0=52 lon_0=10", "nordic", *_sterea()),
    "somerc_fwd": ("somerc lat_0=52 lon_0=10", "nordic", *_somerc()),
    "gstmerc_fwd": ("gstmerc lat_0=52 lon_0=10", "nordic", *_gstmerc()),
    "bonne_fwd": ("bonne lat_1=50 lon_0=10", "nordic", *_bonne()),
    "poly_fwd": ("poly lon_0=10", "nordic", *_poly()),
    "cass_fwd": ("cass lat_0=52 lon_0=10", "nordic", *_cass()),
    "eqearth_fwd": ("eqearth", "world", *_eqearth()),
    "geos_fwd": ("geos h=35785831 lon_0=10", "nordic", *_geos()),
    "tcea_fwd": ("tcea a=6400000 lon_0=10", "nordic", f"{d(R)} * cos(phi) * sin(lam - {d(radians(10))})", f"{d(R)} * atan2(tan(phi), cos(lam - {d(radians(10))}))"),
    "ortho_sphere": ("ortho R=6400000 lat_0=52 lon_0=10", "nordic", f"{d(R)} * cos(phi) * sin(lam - {d(radians(10))})", f"{d(R)} * ({d(cos(radians(52)))} * sin(phi) - {d(sin(radians(52)))} * cos(phi) * cos(lam - {d(radians(10))}))"),
}


#: Where the arc's series leaves a tenth of a micrometre, digits by query; else 3.
DIGITS = {"eqc_fwd": 2, "sinu_fwd": 2, "poly_fwd": 2}


def plane_sql(name: str) -> str:
    _, area, x, y = PLANE[name]
    n = DIGITS.get(name, 3)
    return f"{pts(area)} SELECT k, round({x}, {n}) + 0.0 AS x, round({y}, {n}) + 0.0 AS y FROM pts"


def _geocentric(h: str = "h") -> tuple[str, str, str]:
    return f"(({NU} + {h}) * cos(phi) * cos(lam))", f"(({NU} + {h}) * cos(phi) * sin(lam))", f"(({NU} * {d(1 - ES)} + {h}) * sin(phi))"


def sql() -> dict[str, str]:
    out = {name: plane_sql(name) for name in PLANE}
    x, y, z = _geocentric()
    steps, east, north = transverse(15, 0.9996, 500000)
    out["utm33_customers"] = f"{pts('nordic')}{steps} SELECT k, round({east}, 3) + 0.0 AS x, round({north}, 3) + 0.0 AS y FROM tn"
    out["webmerc_inv"] = f"{pts('world')} SELECT k, round(degrees((lon * 100000) / 6378137), 8) + 0.0 AS lon_out, round(degrees(2 * atan(exp(lat * 100000 / 6378137)) - {d(pi / 2)}), 8) + 0.0 AS lat_out FROM pts"
    out["cart_fwd"] = f"{pts('world')} SELECT k, round({x}, 3) + 0.0 AS x, round({y}, 3) + 0.0 AS y, round({z}, 3) + 0.0 AS z FROM pts"
    out["cart_roundtrip"] = f"{pts('world')} SELECT k, round(lat, 7) + 0.0 AS lat_out, round(lon, 7) + 0.0 AS lon_out, round(h, 3) + 0.0 AS h_out FROM pts"
    # similarity transformations on geocentric coordinates; rotations of a coordinate frame, exact
    sec = radians(1 / 3600)
    rx, ry, rz = -0.0394924 * sec, -0.0327221 * sec, -0.0328979 * sec
    s = 1 - 0.009994e-6
    rows = [
        (cos(ry) * cos(rz), cos(rx) * sin(rz) + sin(rx) * sin(ry) * cos(rz), sin(rx) * sin(rz) - cos(rx) * sin(ry) * cos(rz)),
        (-cos(ry) * sin(rz), cos(rx) * cos(rz) - sin(rx) * sin(ry) * sin(rz), sin(rx) * cos(rz) + cos(rx) * sin(ry) * sin(rz)),
        (sin(ry), -sin(rx) * cos(ry), cos(rx) * cos(ry)),
    ]
    move = (0.06155, -0.01087, -0.04019)
    outs = ", ".join(f"round({d(t)} + {d(s)} * ({d(r[0])} * gx + {d(r[1])} * gy + {d(r[2])} * gz), 3) + 0.0 AS {n}" for n, r, t in zip("xyz", rows, move, strict=True))
    geo = f", g AS (SELECT *, {x} AS gx, {y} AS gy, {z} AS gz FROM pts)"
    out["helmert7"] = f"{pts('world')}{geo} SELECT k, {outs} FROM g"
    # small rotations with rates, in milliarcseconds a year
    a = tuple(f"({d(v * sec / 1000)} * (t - 2020))" for v in (1.50379, 1.18346, 1.20716))
    out["helmert15_by_epoch"] = f"{pts('world')}{geo} SELECT k, round(gx + {a[2]} * gy - {a[1]} * gz, 3) + 0.0 AS x, round(-{a[2]} * gx + gy + {a[0]} * gz, 3) + 0.0 AS y, round({a[1]} * gx - {a[0]} * gy + gz, 3) + 0.0 AS z FROM g"
    # Qoornoq to GR96: turned about each axis in full
    (sx, cx), (sy, cy), (sz, cz) = ((d(sin(v * sec)), d(cos(v * sec))) for v in (-0.85735, 0.36082, 0.38626))
    about_x = f"r1 AS (SELECT k, gx AS u, {cx} * gy + {sx} * gz AS v, {cx} * gz - {sx} * gy AS w FROM g)"
    about_y = f"r2 AS (SELECT k, {cy} * u - {sy} * w AS u, v, {sy} * u + {cy} * w AS w FROM r1)"
    about_z = f"r3 AS (SELECT k, {cz} * u + {sz} * v AS u, {cz} * v - {sz} * u AS v, w FROM r2)"
    grown = d(1 - 8.356137e-6)
    out["similarity_register"] = f"{pts('world')}{geo}, {about_x}, {about_y}, {about_z} SELECT k, round({grown} * u + {d(197.8579)}, 3) + 0.0 AS x, round({grown} * v + {d(146.5947)}, 3) + 0.0 AS y, round({grown} * w - {d(108.8501)}, 3) + 0.0 AS z FROM r3"
    th = -1.244048 * sec
    c, e = 0.304794780637 * cos(th), 0.304794780637 * sin(th)
    out["helmert4"] = f"{pts('nordic')} SELECT k, round({d(-9597.3572)} + {d(c)} * lon * 100000 + {d(e)} * lat * 100000, 3) + 0.0 AS x, round(0.6112::DOUBLE - {d(e)} * lon * 100000 + {d(c)} * lat * 100000, 3) + 0.0 AS y FROM pts"
    px, py, pz = 3500000.0, 800000.0, 5200000.0
    r1 = 1.5 * sec
    s = 1 + 2.5e-6
    out["molobadekas"] = f"{pts('nordic')}{geo} SELECT k, round({d(px + 10)} + {d(s)} * (gx - {d(px)}), 3) + 0.0 AS x, round({d(py + 20)} + {d(s)} * ((gy - {d(py)}) + {d(r1)} * (gz - {d(pz)})), 3) + 0.0 AS y, round({d(pz + 30)} + {d(s)} * ((gz - {d(pz)}) - {d(r1)} * (gy - {d(py)})), 3) + 0.0 AS z FROM g"
    dx, dy, dz, da, df = 84.87, 96.49, 116.95, 251.0, 1.41927e-05
    fac = f"({d(dx)} * cos(lam) + {d(dy)} * sin(lam))"
    dlam = f"({d(dy)} * cos(lam) - {d(dx)} * sin(lam))"
    out["molodensky_full"] = f"{pts('nordic')} SELECT k, round(lon + degrees({dlam} / (({NU} + h) * cos(phi))), 8) + 0.0 AS lon_out, round(lat + degrees(((({d(dz)} + {NU} * {d(ES * da / A)} * sin(phi)) * cos(phi)) - {fac} * sin(phi) + ({RHO} / {d(1 - F)} + {NU} * {d(1 - F)}) * {d(df)} * sin(phi) * cos(phi)) / ({RHO} + h)), 8) + 0.0 AS lat_out, round(h + {fac} * cos(phi) + {d(dz)} * sin(phi) - {d(A * da)} / {NU} + {NU} * {d((1 - F) * df)} * sin(phi) * sin(phi), 3) + 0.0 AS h_out FROM pts"
    ad = A * df + F * da
    out["molodensky_abridged"] = f"{pts('nordic')} SELECT k, round(lon + degrees({dlam} / ({NU} * cos(phi))), 8) + 0.0 AS lon_out, round(lat + degrees(({d(dz)} * cos(phi) - {fac} * sin(phi) + {d(ad)} * sin(2 * phi)) / {RHO}), 8) + 0.0 AS lat_out, round(h + {fac} * cos(phi) + ({d(dz)} + {d(ad)} * sin(phi)) * sin(phi) - {d(da)}, 3) + 0.0 AS h_out FROM pts"
    out["latitude_modes"] = f"{pts('world')} SELECT k, round(degrees(atan({d(1 - ES)} * tan(phi))), 8) + 0.0 AS geocentric, round(degrees(atan({d(1 - F)} * tan(phi))), 8) + 0.0 AS reduced, round(degrees(atan(sinh({psi()}))), 8) + 0.0 AS conformal, round(degrees(asin({qs()} / {d(q_of(pi / 2))})), 8) + 0.0 AS authalic, round(degrees({arc()} / {d(A)}), 8) + 0.0 AS rectifying FROM pts"
    s1, s2 = "(sin(phi) * sin(phi))", "(sin(2 * phi) * sin(2 * phi))"
    g80 = f"9.7803267715::DOUBLE * (1 + {s1} * (5.2790414e-3 + {s1} * (2.327180e-5 + {s1} * (1.262e-7 + {s1} * 7.0e-10)))) - (3.0877e-6 - 4.3e-9 * {s1} + 7.2e-13 * h) * h"
    wel = f"(1 + 0.0053024::DOUBLE * {s1} - 0.0000058::DOUBLE * {s2}) * 9.780318::DOUBLE - 0.000003085::DOUBLE * h"
    cas = f"9.78049::DOUBLE * (1 + 5.2884e-3 * {s1} - 5.9e-6 * {s2}) - (3.08e-6 - 4.19e-10 * 2800) * h"
    out["gravity_models"] = f"{pts('world')} SELECT c_nationkey AS nation, round(avg({g80}), 8) AS grs80, round(avg({wel}), 8) AS welmec, round(avg({cas}), 8) AS cassinis, count(*) AS n FROM pts JOIN customer ON k = c_custkey GROUP BY c_nationkey"
    out["curvature_modes"] = f"{pts('world')} SELECT k, round({NU}, 3) + 0.0 AS prime, round({RHO}, 3) + 0.0 AS meridian, round(sqrt({NU} * {RHO}), 3) + 0.0 AS gaussian, round(2 / (1 / {NU} + 1 / {RHO}), 3) + 0.0 AS mean FROM pts"
    gc = f"sin(atan({d(1 - ES)} * tan(phi)))"
    out["permtide"] = f"{pts('world')} SELECT k, round(h + 1.3::DOUBLE * 0.198::DOUBLE * (1.5::DOUBLE * {gc} * {gc} - 0.5::DOUBLE), 6) + 0.0 AS h_out FROM pts"
    out["unitconvert"] = f"{pts('world')} SELECT k, round(lon * (1200::DOUBLE / 3937::DOUBLE), 6) + 0.0 AS x, round(lat * (1200::DOUBLE / 3937::DOUBLE), 6) + 0.0 AS y, round(h * 0.3048::DOUBLE, 6) + 0.0 AS z FROM pts"
    out["axisswap"] = f"{pts('world')} SELECT k, round(lat, 6) + 0.0 AS x, round(-lon, 6) + 0.0 AS y, round(h, 6) + 0.0 AS z FROM pts"
    out["adapt_orders"] = f"{pts('world')} SELECT k, round(degrees(lam) / 0.9::DOUBLE, 7) + 0.0 AS x, round(-degrees(phi) / 0.9::DOUBLE, 7) + 0.0 AS y, round(-h, 6) + 0.0 AS z FROM pts"
    dm = "(sign(v) * (floor(abs(v) / 100) + (abs(v) - 100 * floor(abs(v) / 100)) / 60))"
    lat_v, lon_v = "(floor(abs(lat)) * 100 * sign(lat) + sign(lat) * 30)", "(floor(abs(lon)) * 100 * sign(lon) + sign(lon) * 15)"
    out["dm_dms"] = f"{pts('world')} SELECT k, round({dm.replace('v', lat_v)}, 8) + 0.0 AS lat_out, round({dm.replace('v', lon_v)}, 8) + 0.0 AS lon_out FROM pts"
    out["geogoffset"] = f"{pts('world')} SELECT k, round(lon + 1, 8) + 0.0 AS lon_out, round(lat - 0.5::DOUBLE, 8) + 0.0 AS lat_out, round(h + 3, 3) + 0.0 AS h_out FROM pts"
    out["lonlat"] = f"{pts('world')} SELECT k, round(lon - 5, 8) + 0.0 AS lon_out, round(lat, 8) + 0.0 AS lat_out FROM pts"
    out["stack_swap_roll"] = f"{pts('world')} SELECT k, round(lat, 6) + 0.0 AS x, round(h, 6) + 0.0 AS y, round(lon + 1, 6) + 0.0 AS z FROM pts"
    out["addone_macro"] = f"{pts('world')} SELECT k, round(lon + 4, 6) + 0.0 AS x, round(lat, 6) + 0.0 AS y FROM pts"
    # a grid whose values are their own position, one node a degree: bilinear interpolation gives the position back
    out["gridshift_fwd"] = f"{pts('nordic')} SELECT k, round(lon + lon / 3600, 8) + 0.0 AS lon_out, round(lat + lat / 3600, 8) + 0.0 AS lat_out FROM pts"
    out["geoid_fwd"] = f"{pts('nordic')} SELECT k, round(h - (lat - lon / 10), 5) + 0.0 AS h_out FROM pts"
    out["gridshift_join"] = f"{pts('nordic')} SELECT k, round(lon, 6) + 0.0 AS v1, round(lat, 6) + 0.0 AS v2 FROM pts"
    vel = ("(lon * 0.001::DOUBLE * (t - 2000))", "(lat * 0.001::DOUBLE * (t - 2000))", "(0.001::DOUBLE * (t - 2000))")
    flat = f", g AS (SELECT *, {_geocentric('0')[0]} AS gx, {_geocentric('0')[1]} AS gy, {_geocentric('0')[2]} AS gz, {vel[0]} AS ve, {vel[1]} AS vn, {vel[2]} AS vu FROM pts)"
    out["deformation_fwd"] = f"{pts('nordic')}{flat} SELECT k, round(gx - sin(lam) * ve - sin(phi) * cos(lam) * vn + cos(phi) * cos(lam) * vu, 3) + 0.0 AS x, round(gy + cos(lam) * ve - sin(phi) * sin(lam) * vn + cos(phi) * sin(lam) * vu, 3) + 0.0 AS y, round(gz + cos(phi) * vn + sin(phi) * vu, 3) + 0.0 AS z FROM g"
    box = "lon BETWEEN 8 AND 16 AND lat BETWEEN 54 AND 58"
    out["grid_membership"] = f"{pts('world')} SELECT k FROM pts WHERE {box}"
    out["grid_misses"] = f"{pts('world')} SELECT k FROM pts WHERE NOT ({box})"
    near = "lon BETWEEN 7.5 AND 16.5 AND lat BETWEEN 53.5 AND 58.5"  # half a cell beyond is still taken
    out["pipeline_success_counts"] = f"{pts('world')} SELECT count(*) AS n, count(*) AS ok_1, count(*) FILTER (WHERE {near}) AS ok_2, count(*) FILTER (WHERE {near}) AS ok_3, count(*) FILTER (WHERE {near}) AS successes FROM pts"
    tile = f"CAST(floor((lam + {d(pi)}) / {d(2 * pi)} * 4) AS INTEGER) AS tx, CAST(floor((1 - asinh(tan(phi)) / {d(pi)}) / 2 * 4) AS INTEGER) AS ty"
    out["bbox_rollup"] = f"{pts('world')}, b AS (SELECT {tile} FROM pts) SELECT tx, ty, count(*) AS n FROM b GROUP BY ROLLUP (tx, ty)"
    ev = f"WITH p0 AS (SELECT ts, {points('nordic', 'events', 'event_id')[7:]}), pts AS (SELECT *, radians(lat) AS phi, radians(lon) AS lam FROM p0)"
    out["events_window_centroid"] = f"{ev} SELECT date_trunc('hour', ts) AS start, round(avg(6378137 * lam), 1) + 0.0 AS x, round(avg(6378137 * asinh(tan(phi))), 1) + 0.0 AS y, count(*) AS n FROM pts GROUP BY 1"
    from . import oracles_more, oracles_tables

    out |= oracles_more.sql()
    return out | oracles_tables.sql(out)
