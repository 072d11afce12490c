"""The operators by name."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from ..functions.mathx import wrapped
from .parameters import Params

#: A direction of an operator: (functions, x, y, z, t) to (x, y, z, t).
Direction = Callable[..., tuple]


@dataclass
class Op:
    """An operator with its parameters bound. `arrow`: it iterates or looks up until done, so it runs on arrays.
    `stored`: it runs on tables alone, by its apply(df, back) over the columns _p0 to _p3."""

    fwd: Direction | None
    inv: Direction | None = None
    arrow: bool = False
    stored: object = None
    one_way: bool = False

    @property
    def turns(self) -> bool:
        """Whether there is an inverse."""
        return self.inv is not None or self.stored is not None and not self.one_way


OPERATORS: dict[str, Callable[[Params], Op]] = {}


def operator(*names: str):
    """Registers a function from parameters to an Op."""

    def put(build):
        for n in names:
            OPERATORS[n] = build
        return build

    return put


def plane(fwd, inv=None, arrow: bool = False) -> Op:
    """An operator on the first two elements."""
    over = lambda f: f and (lambda m, x, y, z, t: (*f(m, x, y), z, t))
    return Op(over(fwd), over(inv), arrow)


def framed(p: Params, fwd, inv, wrap: bool = True, arrow: bool = False, lon_0: float | None = None) -> Op:
    """A projection of longitude from lon_0 and latitude, with false origin; coordinates in metres."""
    lon_0, x_0, y_0 = p.lon_0 if lon_0 is None else lon_0, p.x_0, p.y_0

    def forward(m, lon, lat):
        lam = m.let(wrapped(m, lon - lon_0) if wrap else lon - lon_0)
        x, y = fwd(m, lam, lat)
        return x + x_0, y + y_0

    def back(m, x, y):
        lam, lat = inv(m, *m.let(x - x_0, y - y_0))
        return wrapped(m, lam + lon_0) if wrap else lam + lon_0, lat

    return plane(forward, back, arrow)


NAN = math.nan
