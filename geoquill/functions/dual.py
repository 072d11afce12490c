"""Numbers with their derivatives: a third set of elementary functions, over either of the other two.

A value carries what it changes by with longitude and with latitude, exactly, through every formula that is written
against the interface (`Sql` for columns, `Np` for arrays). Derivatives that are nothing stay the number 0.0 and make
no expression. Branches take the derivatives of the side they take.
"""

from __future__ import annotations



def _zero(v) -> bool:
    return isinstance(v, (int, float)) and v == 0


def _plus(a, b):
    return b if _zero(a) else a if _zero(b) else a + b


def _minus(a, b):
    return a if _zero(b) else -b if _zero(a) else a - b


def _times(a, b):
    return 0.0 if _zero(a) or _zero(b) else a * b


class D:
    """A value, and its derivatives."""

    __slots__ = ("v", "x", "y")

    def __init__(self, v, x=0.0, y=0.0):
        self.v, self.x, self.y = v, x, y

    def __add__(self, o):
        o = dual(o)
        return D(self.v + o.v, _plus(self.x, o.x), _plus(self.y, o.y))

    __radd__ = __add__

    def __sub__(self, o):
        o = dual(o)
        return D(self.v - o.v, _minus(self.x, o.x), _minus(self.y, o.y))

    def __rsub__(self, o):
        return dual(o) - self

    def __mul__(self, o):
        o = dual(o)
        return D(self.v * o.v, _plus(_times(self.x, o.v), _times(self.v, o.x)), _plus(_times(self.y, o.v), _times(self.v, o.y)))

    __rmul__ = __mul__

    def __truediv__(self, o):
        o = dual(o)
        q = self.v / o.v
        part = lambda a, b: 0.0 if _zero(a) and _zero(b) else _minus(a, _times(q, b)) / o.v
        return D(q, part(self.x, o.x), part(self.y, o.y))

    def __rtruediv__(self, o):
        return dual(o) / self

    def __pow__(self, n):
        return D(self.v**n, _times(self.x, n * self.v ** (n - 1)), _times(self.y, n * self.v ** (n - 1)))

    def __neg__(self):
        return D(-self.v, _minus(0.0, self.x), _minus(0.0, self.y))

    def __lt__(self, o):
        return self.v < dual(o).v

    def __le__(self, o):
        return self.v <= dual(o).v

    def __gt__(self, o):
        return self.v > dual(o).v

    def __ge__(self, o):
        return self.v >= dual(o).v


def dual(v) -> D:
    return v if isinstance(v, D) else D(v)


class Dual:
    """The elementary functions over duals; `m` has those over their parts."""

    def __init__(self, m):
        self.m = m

    def let(self, *values):
        out = []
        for v in values:
            if isinstance(v, D):
                parts = [p if isinstance(p, (int, float)) else self.m.let(p) for p in (v.v, v.x, v.y)]
                out.append(D(*parts))
            else:
                out.append(v if isinstance(v, (int, float)) else self.m.let(v))
        return out if len(out) > 1 else out[0]

    def _chain(self, a, value, slope) -> D:
        """The function's value, and its slope times the argument's derivatives."""
        a = dual(a)
        if _zero(a.x) and _zero(a.y):
            return D(value)
        s = slope if isinstance(slope, (int, float)) else self.m.let(slope)
        return D(value, _times(a.x, s), _times(a.y, s))

    def _named(self, a) -> tuple[D, object]:
        a = self.let(dual(a))
        return a, a.v

    def where(self, c, a, b):
        a, b = dual(a), dual(b)
        part = lambda p, q: 0.0 if _zero(p) and _zero(q) else self.m.where(c, p, q)
        return D(self.m.where(c, a.v, b.v), part(a.x, b.x), part(a.y, b.y))

    def isnan(self, a):
        return self.m.isnan(dual(a).v)

    def failed(self, *values, last: bool = False):
        return self.m.failed(*(dual(v).v for v in values), last=last)

    def ratio(self, a, b):
        a, b = dual(a), dual(b)
        q = self.m.let(self.m.ratio(a.v, b.v))
        part = lambda p, r: 0.0 if _zero(p) and _zero(r) else self.m.ratio(_minus(p, _times(q, r)), b.v)
        return D(q, part(a.x, b.x), part(a.y, b.y))

    def until(self, *_):
        raise ValueError("loops have no derivatives")

    def floor(self, a):
        return D(self.m.floor(dual(a).v))

    def rint(self, a):
        return D(self.m.rint(dual(a).v))

    def sign(self, a):
        return D(self.m.sign(dual(a).v))

    def pick(self, values, index):
        return D(self.m.pick(values, dual(index).v))

    def abs(self, a):
        a, v = self._named(a)
        return self._chain(a, self.m.abs(v), self.m.sign(v))

    def power(self, a, b):
        a, v = self._named(a)
        if isinstance(b, D):
            return self.exp(self.log(a) * b)
        return self._chain(a, self.m.power(v, b), self.m.power(v, b - 1.0) * b)

    def atan2(self, a, b):
        a, b = self.let(dual(a)), self.let(dual(b))
        r = self.m.let(a.v * a.v + b.v * b.v)
        part = lambda p, q: 0.0 if _zero(p) and _zero(q) else _minus(_times(b.v, p), _times(a.v, q)) / r
        return D(self.m.atan2(a.v, b.v), part(a.x, b.x), part(a.y, b.y))

    def hypot(self, a, b):
        a, b = self.let(dual(a)), self.let(dual(b))
        h = self.m.let(self.m.hypot(a.v, b.v))
        part = lambda p, q: 0.0 if _zero(p) and _zero(q) else _plus(_times(a.v, p), _times(b.v, q)) / h
        return D(h, part(a.x, b.x), part(a.y, b.y))

    def minimum(self, a, b):
        a, b = self.let(dual(a)), self.let(dual(b))
        return self.where((a.v < b.v) | self.m.isnan(a.v), a, b)

    def maximum(self, a, b):
        a, b = self.let(dual(a)), self.let(dual(b))
        return self.where((a.v > b.v) | self.m.isnan(a.v), a, b)


def _rule(name: str, slope):
    """A function of one argument: slope(m, argument, value)."""

    def f(self, a):
        a, v = self._named(a)
        value = self.m.let(getattr(self.m, name)(v))
        return self._chain(a, value, slope(self.m, v, value))

    setattr(Dual, name, f)


for _name, _slope in {
    "sin": lambda m, v, f: m.cos(v), "cos": lambda m, v, f: -m.sin(v), "tan": lambda m, v, f: 1.0 + f * f, "asin": lambda m, v, f: 1.0 / m.sqrt(1.0 - v * v), "acos": lambda m, v, f: -1.0 / m.sqrt(1.0 - v * v),
    "atan": lambda m, v, f: 1.0 / (1.0 + v * v), "sinh": lambda m, v, f: m.cosh(v), "cosh": lambda m, v, f: m.sinh(v), "tanh": lambda m, v, f: 1.0 - f * f, "asinh": lambda m, v, f: 1.0 / m.sqrt(1.0 + v * v),
    "atanh": lambda m, v, f: 1.0 / (1.0 - v * v), "exp": lambda m, v, f: f, "sqrt": lambda m, v, f: 0.5 / f, "log": lambda m, v, f: 1.0 / v, "log1p": lambda m, v, f: 1.0 / (1.0 + v),
}.items():
    _rule(_name, _slope)

