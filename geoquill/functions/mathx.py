"""One set of elementary functions over two kinds of values: SQL text for columns, and numpy arrays.

Operators are written once against this interface. `Sql` builds expressions that Catalyst compiles; `let` names an
intermediate value, so that it is computed once in a stage of its own and expressions stay short. `Np` computes at
once: in the driver for constants of a plan, in Arrow batches where a plan asks for it.

Missing values are NaN, never NULL. Division follows IEEE 754, whatever the session's ANSI setting.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np

NAN = "double('NaN')"
#: Characters of expressions that make a span of generated code of about 3000 bytes; the JVM compiles up to 8000.
SPAN = 1500


class E:
    """SQL text of a double (or boolean) value, and how many stages of named values lie below it."""

    __slots__ = ("s", "level")

    def __init__(self, s: str, level: int = 0):
        self.s, self.level = s, level

    def _two(self, other, form: str, turned: bool = False) -> E:
        other = wrap(other)
        a, b = (other, self) if turned else (self, other)
        return E(form.format(a.s, b.s), max(a.level, b.level))

    def __add__(self, o):
        return self._two(o, "({} + {})")

    def __radd__(self, o):
        return self._two(o, "({} + {})", True)

    def __sub__(self, o):
        return self._two(o, "({} - {})")

    def __rsub__(self, o):
        return self._two(o, "({} - {})", True)

    def __mul__(self, o):
        return self._two(o, "({} * {})")

    def __rmul__(self, o):
        return self._two(o, "({} * {})", True)

    def __truediv__(self, o):
        if isinstance(o, (int, float)):
            return self._two(o, "({} / {})")
        # a zero divisor gives an infinity of the dividend's sign
        o = wrap(o)
        return E(f"coalesce(try_divide({self.s}, {o.s}), {self.s} * double('Infinity'))", max(self.level, o.level))

    def __rtruediv__(self, o):
        return wrap(o) / self

    def __neg__(self):
        return E(f"(- {self.s})", self.level)

    def __lt__(self, o):
        return self._two(o, "({} < {})")

    def __le__(self, o):
        return self._two(o, "({} <= {})")

    def __gt__(self, o):
        return self._two(o, "({} > {})")

    def __ge__(self, o):
        return self._two(o, "({} >= {})")

    def __and__(self, o):
        return self._two(o, "({} AND {})")

    def __or__(self, o):
        return self._two(o, "({} OR {})")

    def __invert__(self):
        return E(f"(NOT {self.s})", self.level)


def wrap(v) -> E:
    if isinstance(v, E):
        return v
    if isinstance(v, (bool, np.bool_)):
        return E("true" if v else "false")
    v = float(v)
    if math.isnan(v):
        return E(NAN)
    if math.isinf(v):
        return E("double('Infinity')" if v > 0 else "double('-Infinity')")
    return E(f"({v!r}D)" if v < 0 else f"{v!r}D")


class Sql:
    """Builds column expressions."""

    def __init__(self, prefix: str = "_g"):
        self.prefix, self.stages, self.count, self.weight = prefix, [], 0, 0

    def let(self, *values):
        out = []
        for v in map(wrap, values):
            if not any(c in v.s for c in "( "):
                out.append(v)
                continue
            self.count += 1
            self.weight += len(v.s)
            name = f"{self.prefix}{self.count}"
            while len(self.stages) <= v.level:
                self.stages.append([])
            self.stages[v.level].append((name, v.s))
            out.append(E(name, v.level + 1))
        return out if len(out) > 1 else out[0]

    def _f(self, form: str, *args) -> E:
        args = [wrap(a) for a in args]
        return E(form.format(*(a.s for a in args)), max(a.level for a in args))

    def where(self, c, a, b):
        return self._f("if({}, {}, {})", c, a, b)

    def isnan(self, a):
        return self._f("isnan({})", a)

    def failed(self, *values, last: bool = False):
        """Whether one of some named values is NaN. Every SPAN characters of expressions the question is put as a
        function over an array, which has no generated code: it ends a span of code, so that no method outgrows what
        the JVM compiles. After the `last` step a span may be somewhat longer, since little follows."""
        values = self.let(*values)
        if self.weight < (1.5 if last else 1) * SPAN:
            return reduce(lambda a, b: a | b, map(self.isnan, values))
        self.weight = 0
        return self._f("coalesce(exists(array(" + ", ".join(["{}"] * len(values)) + "), v -> isnan(v)), true)", *values)

    def ratio(self, a, b):
        """a / b where b is never 0."""
        return self._f("coalesce(try_divide({}, {}), " + NAN + ")", a, b)

    def log(self, a):
        return self._f("coalesce(ln({}), " + NAN + ")", a)

    def log1p(self, a):
        return self._f("coalesce(log1p({}), " + NAN + ")", a)

    def floor(self, a):
        return self._f("double(floor({}))", a)

    def rint(self, a):
        return self._f("rint({})", a)

    def asinh(self, a):
        a = self.let(a)
        return self._f("(signum({0}) * log1p(abs({0}) + {0} * {0} / (1D + sqrt({0} * {0} + 1D))))", a)

    def power(self, a, b):
        return self._f("pow({}, {})", a, b)

    def atan2(self, a, b):
        return self._f("atan2({}, {})", a, b)

    def hypot(self, a, b):
        return self._f("hypot({}, {})", a, b)

    def minimum(self, a, b):
        a, b = self.let(a), self.let(b)
        return self._f("if({0} < {1} OR isnan({0}), {0}, {1})", a, b)

    def maximum(self, a, b):
        a, b = self.let(a), self.let(b)
        return self._f("if({0} > {1} OR isnan({0}), {0}, {1})", a, b)

    def pick(self, values, index):
        """values[index] of a table of numbers; index is a whole number within it."""
        table = ", ".join(wrap(v).s for v in values)
        return self._f("coalesce(try_element_at(array(" + table + "), int({}) + 1), " + NAN + ")", index)


    def named(self, df):
        """df with the named values as columns. Stages go into one selection, whose later items refer to earlier ones,
        since each selection by itself would be analysed with all that lies below it; functions over arrays can't refer
        to items of their own selection, so they begin a new one."""
        parts: list[list[str]] = [[]]
        for stage in self.stages:
            arrays = any("->" in s for _, s in stage)
            if arrays:
                parts.append([])
            parts[-1] += [f"{s} AS {n}" for n, s in stage]
            if arrays:
                parts.append([])
        for part in parts:
            df = df.selectExpr("*", *part) if part else df
        return df

    def until(self, state: dict, step, done: str, rounds: int) -> dict:
        """Values that `step` (from and to a dict) changes until the one named `done` is true, for so many rounds at
        most: an expression without generated code, for the few rows that need it."""
        fields = lambda values: ", ".join(f"'{k}', {wrap(v).s}" for k, v in values.items())
        inner = Sql(f"{self.prefix}w")
        made = {k: wrap(v) for k, v in step(inner, {k: E(f"_w.{k}") for k in state}).items()}
        body = inner.bound(f"named_struct({fields(made)})")
        start = {k: wrap(v) for k, v in state.items()}
        # rounds by rounds of rounds, so that a value that is done soon is passed on a few times only
        few = math.isqrt(rounds)
        some = lambda first: f"aggregate(sequence(1, {few}), {first}, (_w, _i) -> if(_w.{done}, _w, {body}))"
        text = f"if({start[done].s}, named_struct({fields(start)}), aggregate(sequence(1, {-(-rounds // few)}), named_struct({fields(start)}), (_o, _j) -> if(_o.{done}, _o, {some('_o')})))"
        out = self.let(E(text, max(v.level for v in start.values())))
        return {k: E(f"{out.s}.{k}", out.level) for k in state}

    def bound(self, text: str) -> str:
        """An expression over the named values as one expression, with the values bound by functions of one element."""
        for level in range(len(self.stages) - 1, -1, -1):
            names = ", ".join(f"'{n}', {s}" for n, s in self.stages[level])
            text = f"element_at(transform(array(named_struct({names})), {self.prefix}L{level} -> {text}), 1)"
        where = {n: f"{self.prefix}L{k}.{n}" for k, stage in enumerate(self.stages) for n, _ in stage}
        # names stand for themselves where they are made, and for a field of their stage where they are used
        return re.sub(rf"(?<![\w'.]){self.prefix}\d+\b", lambda f: where.get(f[0], f[0]), text)


for _name, _sql in {"sin": "sin", "cos": "cos", "tan": "tan", "asin": "asin", "acos": "acos", "atan": "atan", "sinh": "sinh", "cosh": "cosh", "tanh": "tanh", "atanh": "atanh", "exp": "exp", "sqrt": "sqrt", "abs": "abs", "sign": "signum"}.items():
    setattr(Sql, _name, (lambda form: lambda self, a: self._f(form, a))(_sql + "({})"))


class Np:
    """Computes with numpy, on numbers or arrays."""

    @staticmethod
    def let(*values):
        return list(values) if len(values) > 1 else values[0]

    @staticmethod
    def failed(*values, last: bool = False):
        return reduce(np.logical_or, map(np.isnan, values))

    @staticmethod
    def until(state: dict, step, done: str, rounds: int) -> dict:
        keys = list(state)
        values = {k: np.array(v) for k, v in zip(keys, np.broadcast_arrays(*state.values()), strict=True)}
        shape = values[done].shape
        values = {k: np.atleast_1d(v).copy() for k, v in values.items()}
        for _ in range(rounds):
            rows = np.flatnonzero(~values[done].astype(bool))  # only rows that still move are computed
            if not len(rows):
                break
            made = step(Np, {k: v[rows] for k, v in values.items()} | {"rows": rows})
            for k in keys:
                values[k][rows] = made[k]
        return {k: v.reshape(shape) for k, v in values.items()}

    @staticmethod
    def ratio(a, b):
        return a / b

    @staticmethod
    def pick(values, index):
        index = np.asarray(index, float)
        good = np.isfinite(index) & (index >= 0) & (index < len(values))
        return np.where(good, np.asarray(values, float)[np.where(good, index, 0).astype(int)], np.nan)

    where, isnan, log, log1p, floor, rint, asinh, power, atan2, hypot, minimum, maximum = (staticmethod(f) for f in (np.where, np.isnan, np.log, np.log1p, np.floor, np.rint, np.arcsinh, np.power, np.arctan2, np.hypot, np.minimum, np.maximum))
    sin, cos, tan, asin, acos, atan, sinh, cosh, tanh, atanh, exp, sqrt, abs, sign = (staticmethod(f) for f in (np.sin, np.cos, np.tan, np.arcsin, np.arccos, np.arctan, np.sinh, np.cosh, np.tanh, np.arctanh, np.exp, np.sqrt, np.abs, np.sign))


def clamp(m, v, low, high):
    return m.minimum(m.maximum(v, low), high)


def wrapped(m, lon):
    """An angle brought into (-pi, pi]."""
    lon = m.let(lon)
    return m.where(m.abs(lon) <= math.pi, lon, lon - 2 * math.pi * m.floor((lon + math.pi) / (2 * math.pi)))


def copysign(m, size, like):
    return m.where(like < 0, -m.abs(size), m.abs(size))


def sine_series(m, c, angle):
    """Sum of c[k] sin((k + 1) angle), by Clenshaw's recurrence."""
    angle = m.let(angle)
    twice = m.let(2 * m.cos(angle))
    c = [float(v) for v in c]
    b0, b1 = c[-1], 0.0
    for v in reversed(c[:-1]):
        b0, b1 = m.let(twice * b0 - b1 + v), b0
    return m.sin(angle) * b0


def complex_sine_series(m, c, re, im):
    """Sum of c[k] sin((k + 1) (re + i im)): real and imaginary part."""
    re, im = m.let(re), m.let(im)
    s, co, sh, ch = m.let(m.sin(re), m.cos(re), m.sinh(im), m.cosh(im))
    return complex_sine_parts(m, c, s, co, sh, ch)


def complex_sine_parts(m, c, s, co, sh, ch):
    """The same from sines and cosines of the angle's parts."""
    r, i = m.let(2 * co * ch, -2 * s * sh)
    (r0, i0), (r1, i1) = (float(c[-1]), 0.0), (0.0, 0.0)
    for v in reversed(list(c)[:-1]):
        new = (r * r0 - i * i0 - r1 + float(v), r * i0 + i * r0 - i1)
        (r0, i0), (r1, i1) = m.let(*new), (r0, i0)
    a, b = m.let(s * ch, co * sh)
    return a * r0 - b * i0, a * i0 + b * r0
