"""Inverses by Newton's method on arrays, for projections whose forward form is all there is."""

from __future__ import annotations

import numpy as np


def invert(fwd, x, y, lam, phi, rounds: int = 30, tolerance: float = 1e-13, step: float = 1e-6):
    """(lam, phi) with fwd(lam, phi) = (x, y), from a guess; NaN where it doesn't converge. Scales: x and y in radii."""
    x, y, lam, phi = (np.array(v, float) for v in np.broadcast_arrays(x, y, lam, phi))
    done = np.zeros(x.shape, bool)
    for _ in range(rounds):
        fx, fy = fwd(lam, phi)
        ax, ay = fwd(lam + step, phi)
        bx, by = fwd(lam - step, phi)
        # latitudes stay off the pole, where the difference would leave the domain
        up, down = np.minimum(phi + step, np.pi / 2), np.maximum(phi - step, -np.pi / 2)
        cx, cy = fwd(lam, up)
        dx, dy = fwd(lam, down)
        a, b = (ax - bx) / (2 * step), (cx - dx) / (up - down)
        c, d = (ay - by) / (2 * step), (cy - dy) / (up - down)
        rx, ry = x - fx, y - fy
        det = a * d - b * c
        dl, dp = (d * rx - b * ry) / det, (a * ry - c * rx) / det
        live = ~done & np.isfinite(dl) & np.isfinite(dp)
        lam = np.where(live, lam + np.clip(dl, -0.4, 0.4), lam)
        phi = np.where(live, np.clip(phi + np.clip(dp, -0.3, 0.3), -np.pi / 2, np.pi / 2), phi)
        done |= live & (np.hypot(dl, dp) < tolerance) | (np.hypot(rx, ry) < 1e-15)
        if done.all():
            break
    fx, fy = fwd(lam, phi)
    good = np.hypot(x - fx, y - fy) < 1e-9
    return np.where(good, lam, np.nan), np.where(good, phi, np.nan)


def root(f, start, rounds: int = 60, tolerance: float = 1e-14, step: float = 1e-6):
    """A zero of a function of one array, from a guess; NaN where it doesn't converge."""
    v = np.array(start, float)
    for _ in range(rounds):
        change = f(v) * 2 * step / (f(v + step) - f(v - step))
        change = np.where(np.isfinite(change), change, 0)
        v = v - change
        if (np.abs(change) < tolerance).all():
            break
    return np.where(np.abs(f(v)) < 1e-9, v, np.nan)
