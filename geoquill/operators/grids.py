"""Grid-based shifts: datum and height grids, deformation, deflection of the vertical.

Grids are found by name: in the context's memory, as files in its folders, in its store. Those in memory and in files
are small and looked up on arrays, one decoded copy in each worker (see sources.gridcache). A step that names a stored
grid is made of joins instead (see plans.stored).
"""

from __future__ import annotations

import math

import numpy as np

from ..functions.mathx import Np, wrapped
from ..plans import stored
from ..plans.parameters import Params
from ..plans.registry import Op, operator

SECOND = math.pi / 180 / 3600


class Stack:
    """Grids in order of preference; `@` marks those that may be missing, `@null` takes all points that no other has."""

    def __init__(self, p: Params):
        self.grids, self.null = [], False
        for name in p.texts("grids"):
            if name == "@null":
                self.null = True
                break
            grid = p.context.grid(name.removeprefix("@")) if p.context else None
            if grid is not None:
                self.grids.append(grid)
            elif not name.startswith("@"):
                raise p.fail(f"no grid {name}")
        self.bands = self.grids[0].bands if self.grids else 0
        self.kind = self.grids[0].kind if self.grids else "horizontal"
        self.projected = bool(self.grids) and self.grids[0].projected
        self.stored = any(isinstance(g, stored.Stored) for g in self.grids)

    @property
    def tables(self) -> stored.Tables:
        return stored.Tables(self.grids, self.null)

    def at(self, lon, lat):
        """Values of the first grid that holds a point, then of the first within half a cell of it; NaN elsewhere,
        or 0 with the null grid."""
        lon, lat = np.broadcast_arrays(np.asarray(lon, float), np.asarray(lat, float))
        out = np.full((*lon.shape, self.bands), np.nan)
        open_ = np.ones(lon.shape, bool)
        for margin in (0.0, 0.5):
            for grid in self.grids:
                held = open_ & grid.contains(lon, lat, margin)
                if held.any():
                    out = np.where(held[..., None], grid.at(lon, lat, margin)[..., : self.bands], out)
                    open_ &= ~held
        return np.where(open_[..., None], 0.0, out) if self.null else out


@operator("gridshift")
def gridshift(p: Params) -> Op:
    """One band: heights above the ellipsoid to heights above the geoid. Two: longitude and latitude, in arc seconds.
    Three: and heights."""
    grids, flat = Stack(p), p.flag("no_z_transform")
    if not grids.grids:
        same = lambda m, x, y, z, t: (x, y, z, t)
        return Op(same, same)
    if grids.stored:
        return Op(None, None, stored=stored.Shift(grids.tables, grids.kind, grids.bands, grids.projected, flat))
    unit = 1.0 if grids.projected else SECOND
    level = lambda lon: lon if grids.projected else wrapped(Np, lon)

    if grids.bands == 1:
        sign = 1.0 if grids.kind in ("vertical", "ellipsoidal") and not flat else -1.0
        fwd = lambda m, x, y, z, t: ((v := grids.at(x, y)[..., 0]) * 0 + level(x), y + v * 0, z + sign * v, t)
        inv = lambda m, x, y, z, t: ((v := grids.at(x, y)[..., 0]) * 0 + x, y + v * 0, z - sign * v, t)
        return Op(fwd, inv, arrow=True)

    heights = grids.bands > 2 and not flat

    def fwd(m, x, y, z, t):
        d = grids.at(x, y)
        return level(x + d[..., 0] * unit), y + d[..., 1] * unit, z + d[..., 2] if heights else z, t

    def inv(m, x, y, z, t):
        u, v = np.array(x, float), np.array(y, float)
        moved = np.full(np.shape(u), np.inf)
        for _ in range(10):  # the shift at the point sought
            d = grids.at(u, v)
            a, b = x - d[..., 0] * unit, y - d[..., 1] * unit
            moved = np.hypot(a - u, b - v)
            u, v = a, b
            if not (moved > 1e-12).any():
                break
        good = moved < 1e-12
        d = grids.at(u, v)
        return np.where(good, u, np.nan), np.where(good, v, np.nan), z - d[..., 2] if heights else z, t

    return Op(fwd, inv, arrow=True)


@operator("deformation")
def deformation(p: Params) -> Op:
    """Velocities east, north and up in millimetres a year, for cartesian coordinates, over the time since t_epoch or
    over dt years. Forward adds them."""
    grids, e = Stack(p), p.ellps()
    if grids.bands != 3:
        raise p.fail("a grid of three bands is needed")
    dt, epoch, raw = p.real("dt", math.nan), p.real("t_epoch", math.nan), p.flag("raw")
    if math.isnan(dt) and math.isnan(epoch):
        raise p.fail("dt or t_epoch is needed")
    if grids.stored:
        return Op(None, None, stored=stored.Velocity(grids.tables, e, dt, epoch, raw))

    def moved(sign: float):
        def run(m, x, y, z, t):
            lon, lat, _ = e.geographic(Np, x, y, z)
            v = grids.at(lon, lat) * 0.001 * sign
            span = dt if math.isfinite(dt) else t - epoch
            sl, cl, sp, cp = np.sin(lon), np.cos(lon), np.sin(lat), np.cos(lat)
            east, north, up = (v[..., k] * span for k in range(3))
            dx = -sl * east - sp * cl * north + cp * cl * up
            dy = cl * east - sp * sl * north + cp * sl * up
            dz = cp * north + sp * up
            return (dx, dy, dz, np.sqrt(dx * dx + dy * dy + dz * dz)) if raw else (x + dx, y + dy, z + dz, t)

        return run

    return Op(moved(1.0), moved(-1.0), arrow=True)


@operator("deflection")
def deflection(p: Params) -> Op:
    """Deflection of the vertical at (lat, lon) in degrees: north and east component in arc seconds, by differences of
    geoid heights over a metre."""
    grids, e = Stack(p), p.ellps()
    if grids.stored:
        return Op(None, None, stored=stored.Deflection(grids.tables, e), one_way=True)

    def fwd(m, x, y, z, t):
        lat, lon = x * (math.pi / 180), y * (math.pi / 180)
        north = e.lat_of_arc(Np, e.arc(Np, lat) + 1.0)
        east = lon + 1 / (np.cos(lat) * e.prime_vertical(Np, lat))
        n = grids.at(lon, lat)[..., 0]
        xi, eta = grids.at(lon, north)[..., 0] - n, grids.at(east, lat)[..., 0] - n
        return np.arctan(xi) / SECOND, np.arctan(eta) / SECOND, z, t

    return Op(fwd, arrow=True)
