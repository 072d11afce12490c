"""Compiled pipelines over DataFrames.

A pipeline is resolved in the driver: macros, arguments, inversions, omitted steps and the column stack, which is a
list of names at that time. What remains is a chain of column expressions with named intermediate values, in as many
`select` stages as they depend on each other; Catalyst merges those that are used once, and all of them run in one
span of generated code. Pipelines with an operator that iterates run over Arrow batches in one hop instead. Either
form is a projection: it keeps partitioning and order, shuffles nothing, and works on streams.

Steps over stored grids are joins. A pipeline with such steps is compiled in parts, with the tuple and the column stack
in columns between them.

A tuple that fails is NaN throughout, and `ok` is false. Null input counts as NaN.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import groupby
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.mathx import E, Np, Sql, wrap
from ..sources.gridcache import Handle, InFile, Sent
from . import registers, stored
from .language import PipelineError, Step, expand, inverted
from .parameters import Params
from .registry import OPERATORS, Op

#: Adaptors that every context knows.
ADAPTORS = {
    "geo:in": "adapt from=neuf_deg", "geo:out": "adapt to=neuf_deg", "gis:in": "adapt from=enuf_deg", "gis:out": "adapt to=enuf_deg",
    "neu:in": "adapt from=neuf", "neu:out": "adapt to=neuf", "enu:in": "adapt from=enuf", "enu:out": "adapt to=enuf",
}
#: A filter over a projection is pushed down by writing its columns' expressions out, again and again through every
#: stage. The results of pipelines with more named values than this are made by `inline` of one struct: filters on
#: them stay above, filters on the input's columns go down to the scan.
LONG = 8
STACK = ("push", "pop", "roll", "unroll", "swap", "flip", "drop")


class Context:
    """Macros, operators and grids that pipelines of a session know. Macros that aren't registered are looked for in
    the folders `paths` and then among the bundled ones (see plans.registers). Grids that aren't registered are looked
    for as files in those folders (and `grids` within), then in the grid store `store`, when a pipeline first names
    them."""

    def __init__(self, paths: list[str] | tuple[str, ...] = (), store: str | None = None):
        self.macros: dict[str, str] = dict(ADAPTORS)
        self.operators: dict[str, Callable[[Params], Op]] = {}
        self.grids: dict[str, object] = {}
        self.paths, self.store = list(paths), store
        self._handles: dict[str, Sent] = {}

    def macro(self, name: str) -> str | None:
        """The text of a macro."""
        if name not in self.macros:
            found = registers.look_up(name, self.paths)
            if found is None:
                return None
            self.macros[name] = found
        return self.macros[name]

    def register_text(self, prefix: str, text: str) -> None:
        """All macros of a register: fenced blocks of a Markdown text."""
        self.macros |= {f"{prefix}:{suffix}": body for suffix, body in registers.blocks(text).items()}

    def register_point_operator(self, name: str, build: Callable[[Params], object]) -> None:
        """An operator on single points: build gives an object with fwd((x, y, z, t)) and, where there is one, inv;
        both give four numbers, or None for a failure. Every point is a Python call: use it where nothing else does."""
        self.operators[name] = lambda p: by_point(build(p))

    def register_macro(self, name: str, text: str) -> None:
        if ":" not in name:
            raise PipelineError("a macro's name has a colon")
        self.macros[name] = text

    def register_operator(self, name: str, build: Callable[[Params], Op]) -> None:
        """A user's operator; it hides a built-in one of the same name."""
        self.operators[name] = build

    def register_grid(self, name: str, grid: object) -> None:
        self.grids[name] = grid
        self._handles.pop(name, None)

    def grid(self, name: str) -> Handle | stored.Stored | None:
        """A grid by name: in memory, in a file, in the store."""
        if name in self.grids:
            held = self._handles.get(name)
            if held is None or held.grid() is not self.grids[name]:
                self._handles[name] = Sent(self.grids[name])
            return self._handles[name]
        for folder in self.paths:
            for path in (Path(folder) / name, Path(folder) / "grids" / name):
                if path.is_file():
                    return InFile(str(path.resolve()), path.name, path.stat().st_mtime_ns)
        session = SparkSession.getActiveSession()
        return stored.find(session, self.store, name) if self.store and session else None

    def pipeline(self, text: str) -> Pipeline:
        return Pipeline(text, self)


class Pipeline:
    def __init__(self, text: str, context: Context | None = None):
        from ..operators import load
        from .proj import native

        load()
        self.text, self.context = text, context or Context()
        self.steps = expand(native(text), self.context.macro)
        if not self.steps:
            self.steps = [Step("noop")]
        self.ops = [self._bind(s) for s in self.steps]

    def _bind(self, step: Step) -> Op | None:
        if step.name == "stack":
            moves = [k for k in STACK if k in step.given]
            if len(moves) != 1:
                raise PipelineError(f"stack: one of {', '.join(STACK)} is needed")
            _arguments(step, moves[0])
            return None
        if step.name in ("push", "pop"):
            return None
        build = self.context.operators.get(step.name) or OPERATORS.get(step.name)
        if build is None:
            raise PipelineError(f"no operator {step.name}")
        op = build(Params(step, self.context))
        if step.flag("inv") and not op.turns:
            raise PipelineError(f"{step.name} has no inverse")
        return op

    def describe(self) -> list[dict]:
        """Name and arguments of each step, macros expanded."""
        return [{"name": s.name, **s.given} for s in self.steps]

    def grid_names(self) -> list[str]:
        """Grids that the pipeline depends on, in order; optional ones with their mark."""
        return list(dict.fromkeys(g for s in self.steps for g in s.given.get("grids", "").split(",") if g))

    @property
    def on_arrays(self) -> bool:
        return any(op is not None and op.arrow for op in self.ops)

    def _order(self, direction: str) -> list[tuple[Step, Op | None]]:
        if direction not in ("fwd", "inv"):
            raise ValueError("direction is fwd or inv")
        pairs = list(zip(self.steps, self.ops, strict=True))
        if direction == "inv":
            pairs = [(inverted(s), op) for s, op in reversed(pairs)]
        # omit_fwd and omit_inv were exchanged along with the direction
        return [(s, op) for s, op in pairs if not s.flag("omit_fwd")]

    def run(self, m, x, y, z, t, direction: str = "fwd", order: list | None = None, stack: list | None = None):
        """(x, y, z, t), and by step whether the tuple was good, in terms of the functions m. `order`: some steps of a
        direction only; `stack` is theirs before, and after."""
        c, stack, good = [x, y, z, t], [] if stack is None else stack, []
        order = self._order(direction) if order is None else order
        for k, (step, op) in enumerate(order, 1):
            back = step.flag("inv")
            if op is None:
                worked = _stack(step, back, c, stack)
                good.append((step.name, worked))
                continue
            if op.stored:
                raise PipelineError(f"{step.name}: stored grids are for tables")
            f = op.inv if back else op.fwd
            if f is None:
                c = [math.nan] * 4
                good.append((step.name, False))
                continue
            c = list(m.let(*f(m, *c)))
            bad = m.let(m.failed(c[0], c[1], last=k == len(order)))
            good.append((step.name, ~bad if not isinstance(bad, (bool, np.bool_)) else not bad))
        return c, good

    def transform(self, df: DataFrame, x: str, y: str, z: str | None = None, t: str | None = None, direction: str = "fwd", into: tuple[str, str, str, str] = ("x", "y", "z", "t"), ok: str | None = "ok", engine: str = "auto", steps: bool = False, observe: Observation | str | None = None) -> DataFrame:
        """All columns of df and the result's; z is 0 and t is NaN where no column is named. With steps, columns
        `ok_1`, ... tell by step whether the tuple was good. engine: auto, columns or arrow.

        `observe`: counts (n, ok_1, ..., successes, as success_counts has them) are taken on the pass that reads the
        result, and are in the Observation after it; of a stream, under that name in the progress of its query."""
        if observe is not None:
            out = self.transform(df, x, y, z, t, direction, into, ok, engine, steps=True)
            marks = [f"ok_{k}" for k in range(1, len(self._order(direction)) + 1)]
            counts = [F.count_if(F.col(k)) for k in marks]
            least = F.least(*counts) if len(counts) > 1 else counts[0]
            out = out.observe(observe, F.count(F.lit(1)).alias("n"), *[c.alias(k) for c, k in zip(counts, marks, strict=True)], least.alias("successes"))
            return out if steps else out.drop(*marks)
        keep = [c for c in df.columns if c not in {*into, ok}]
        if any(op is not None and op.stored for _, op in self._order(direction)):
            return self._by_parts(df, keep, (x, y, z, t), direction, into, ok, steps)
        nan = E("double('NaN')")
        if engine == "arrow" or engine == "auto" and self.on_arrays:
            out = self._arrow(df, x, y, z, t, direction)
            bits = F.col("_geo.bits")
            return out.select(*[f"`{c}`" for c in keep], *[F.coalesce(f"_geo.{k}", F.lit(math.nan)).alias(n) for k, n in zip("xyzt", into, strict=True)], *([F.col("_geo.ok").alias(ok)] if ok else []), *([(F.shiftright(bits, k) % 2 == 1).alias(f"ok_{k + 1}") for k in range(len(self._order(direction)))] if steps else []))
        m = Sql()
        start = [E(f"coalesce(double(`{c}`), double('NaN'))") if c else E("0.0D") if k == 2 else nan for k, c in enumerate((x, y, z, t))]
        start = m.let(*start)
        c, good = self.run(m, *start, direction=direction)
        good = [wrap(g) for _, g in good]
        every = reduce(lambda a, b: a & b, good, E("true"))
        # a tuple that fails is NaN throughout
        made = {n: f"if({every.s}, {wrap(v).s}, double('NaN'))" for v, n in zip(c, into, strict=True)}
        made |= {ok: every.s} if ok else {}
        made |= {f"ok_{k}": g.s for k, g in enumerate(good, 1)} if steps else {}
        df = m.named(df)
        kept = [f"`{k}`" for k in keep]
        if m.count <= LONG:
            return df.selectExpr(*kept, *[f"{v} AS `{n}`" for n, v in made.items()])
        return df.selectExpr(*kept, _struct(made))

    def _by_parts(self, df: DataFrame, keep: list[str], names: tuple, direction: str, into: tuple, ok: str | None, steps: bool) -> DataFrame:
        """The tuple is in the columns _p0 to _p3, the stack in _s0, ..., and each step's success in _ok1, ..."""
        start = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(math.nan)) if c else F.lit(0.0 if k == 2 else math.nan) for k, c in enumerate(names)]
        df = df.select("*", *[c.alias(f"_p{k}") for k, c in enumerate(start)])
        goods, depth = [], 0
        for whole, part in groupby(self._order(direction), lambda s: bool(s[1] is not None and s[1].stored)):
            part = list(part)
            if whole:
                for step, op in part:
                    df = op.stored.apply(df, step.flag("inv"))
                    goods.append(f"_ok{len(goods) + 1}")
                    df = df.withColumn(goods[-1], ~(F.isnan("_p0") | F.isnan("_p1")))
                continue
            known = [c for c in df.columns if c not in {*(f"_p{k}" for k in range(4)), *(f"_s{k}" for k in range(depth))}]
            fresh = [f"_ok{len(goods) + k + 1}" for k in range(len(part))]
            if any(op is not None and op.arrow for _, op in part):
                df, depth = self._part_on_arrays(df, known, part, depth, fresh)
            else:
                m = Sql(f"_g{len(goods)}_")
                stack = [E(f"_s{k}") for k in range(depth)]
                c, good = self.run(m, *m.let(*(E(f"_p{k}") for k in range(4))), order=part, stack=stack)
                df = m.named(df)
                made = {f"_p{k}": v for k, v in enumerate(c)} | {f"_s{k}": v for k, v in enumerate(stack)} | dict(zip(fresh, (g for _, g in good), strict=True))
                depth = len(stack)
                values = {n: wrap(v).s for n, v in made.items()}
                kept = [f"`{k}`" for k in known]
                df = df.selectExpr(*kept, *[f"{v} AS `{n}`" for n, v in values.items()]) if m.count <= LONG else df.selectExpr(*kept, _struct(values))
            goods += fresh
        every = reduce(lambda a, b: a & b, map(F.col, goods), F.lit(True))
        out = [F.when(every, F.col(f"_p{k}")).otherwise(math.nan).alias(n) for k, n in enumerate(into)]
        return df.select(*[f"`{c}`" for c in keep], *out, *([every.alias(ok)] if ok else []), *([F.col(g).alias(f"ok_{k}") for k, g in enumerate(goods, 1)] if steps else []))

    def _part_on_arrays(self, df: DataFrame, known: list[str], part: list, depth: int, fresh: list[str]) -> tuple[DataFrame, int]:
        """A part of the steps in one Arrow hop."""
        left: list = [0.0] * depth
        with np.errstate(all="ignore"):
            self.run(Np, *(np.zeros(1) for _ in range(4)), order=part, stack=left)  # how deep the stack is afterwards
        after, plan = len(left), self
        names = [*(f"_p{k}" for k in range(4)), *(f"_s{k}" for k in range(after)), *fresh]

        @F.pandas_udf(", ".join(f"{n} {'boolean' if n in fresh else 'double'}" for n in names))
        def apply(*columns: pd.Series) -> pd.DataFrame:
            rows = [np.asarray(c, float) for c in columns]
            stack = rows[4:]
            with np.errstate(all="ignore"):
                c, good = plan.run(Np, *rows[:4], order=part, stack=stack)
            shape = rows[0].shape
            values = [*(np.broadcast_to(np.asarray(v, float), shape) for v in (*c, *stack)), *(np.broadcast_to(np.asarray(g, bool), shape) for _, g in good)]
            return pd.DataFrame(dict(zip(names, values, strict=True)))

        df = df.withColumn("_part", apply(*[F.col(f"_p{k}") for k in range(4)], *[F.col(f"_s{k}") for k in range(depth)]))
        return df.select(*[f"`{k}`" for k in known], *[F.col(f"_part.{n}").alias(n) for n in names]), after

    def _arrow(self, df: DataFrame, x: str, y: str, z: str | None, t: str | None, direction: str) -> DataFrame:
        plan = self

        @F.pandas_udf("x double, y double, z double, t double, ok boolean, bits long")
        def apply(x: pd.Series, y: pd.Series, z: pd.Series, t: pd.Series) -> pd.DataFrame:
            return plan.arrays(x, y, z, t, direction)

        number = lambda c, d: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(math.nan)) if c else F.lit(d)
        return df.withColumn("_geo", apply(number(x, 0.0), number(y, 0.0), number(z, 0.0), number(t, math.nan)))

    def arrays(self, x, y, z=0.0, t=math.nan, direction: str = "fwd") -> pd.DataFrame:
        """The same on arrays, in the calling process; `bits` has a bit for each step that went well."""
        x, y, z, t = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, y, z, t)))
        with np.errstate(all="ignore"):
            c, good = self.run(Np, x, y, z, t, direction)
        good = [np.broadcast_to(np.asarray(g, bool), x.shape) for _, g in good]
        every = reduce(np.logical_and, good, np.ones(x.shape, bool))
        bits = sum((g.astype(np.int64) << k for k, g in enumerate(good)), np.zeros(x.shape, np.int64))
        out = {k: np.atleast_1d(np.where(every, v, np.nan)) for k, v in zip("xyzt", c, strict=True)}
        return pd.DataFrame(out | {"ok": np.atleast_1d(every), "bits": np.atleast_1d(bits)})

    def success_counts(self, df: DataFrame, x: str, y: str, z: str | None = None, t: str | None = None, direction: str = "fwd") -> DataFrame:
        """One row: tuples, successes of each step, and of the pipeline, which counts the step with the fewest."""
        done = self.transform(df, x, y, z, t, direction, steps=True)
        n = len(self._order(direction))
        counts = [F.count_if(F.col(f"ok_{k}")).alias(f"ok_{k}") for k in range(1, n + 1)]
        out = done.agg(F.count("*").alias("n"), *counts)
        least = F.least(*[F.col(f"ok_{k}") for k in range(1, n + 1)]) if n > 1 else F.col("ok_1")
        return out.withColumn("successes", least)

    def roundtrip(self, df: DataFrame, x: str, y: str, z: str | None = None, t: str | None = None) -> DataFrame:
        """All columns of df, and what there and back again leaves: dx, dy, dz, dt."""
        there = self.transform(df, x, y, z, t, into=("_x", "_y", "_z", "_t"), ok="_ok")
        back = self.transform(there, "_x", "_y", "_z", "_t", "inv", into=("_x", "_y", "_z", "_t"), ok="_ok")
        start = [F.col(f"`{x}`"), F.col(f"`{y}`"), F.col(f"`{z}`") if z else F.lit(0.0), F.col(f"`{t}`") if t else F.lit(math.nan)]
        return back.select(*[f"`{c}`" for c in df.columns], *[(F.col(f"_{k}") - s).alias(f"d{k}") for k, s in zip("xyzt", start, strict=True)])


def _struct(values: dict[str, str]) -> str:
    """Columns that filters don't go through (see LONG)."""
    return "inline(array(named_struct(" + ", ".join(f"'{n}', {v}" for n, v in values.items()) + ")))"


def _arguments(step: Step, move: str) -> list[int]:
    if move in ("swap", "drop"):
        return []
    try:
        args = [int(v) for v in step.given[move].split(",")]
    except ValueError:
        raise PipelineError(f"stack: {move} takes whole numbers") from None
    if move in ("push", "pop", "flip") and any(not 1 <= a <= 4 for a in args):
        raise PipelineError(f"stack: {move} takes elements 1 to 4")
    if move in ("roll", "unroll") and len(args) != 2:
        raise PipelineError(f"stack: {move} takes two numbers")
    return args


def _stack(step: Step, back: bool, c: list, stack: list) -> bool:
    """Moves names between the tuple and the column stack; what isn't there makes the tuple fail."""
    if step.name in ("push", "pop"):  # the older form, by flags
        which = [i for i in range(4) if step.flag(f"v_{i + 1}")]
        if (step.name == "push") != back:
            stack += [c[i] for i in which]
        else:
            for i in reversed(which):
                c[i] = stack.pop() if stack else math.nan
        return True
    move = next(k for k in STACK if k in step.given)
    args = _arguments(step, move)
    if back:
        if move in ("push", "pop"):
            move, args = ("pop" if move == "push" else "push"), args[::-1]
        elif move in ("roll", "unroll"):
            args = [args[0], args[0] - args[1]]
    fails = False
    if move == "push":
        stack += [c[a - 1] for a in args]
    elif move in ("pop", "flip"):
        fails = len(stack) < len(args)
        if not fails and move == "pop":
            for a in args:
                c[a - 1] = stack.pop()
        elif not fails:
            for k, a in enumerate(args, 1):
                c[a - 1], stack[-k] = stack[-k], c[a - 1]
    elif move in ("roll", "unroll"):
        depth, n = args
        if move == "unroll":
            n = depth - n
        fails = len(stack) < depth
        if not fails and depth:
            top = stack[-depth:]
            n %= depth
            stack[-depth:] = top[-n:] + top[:-n] if n else top
    elif move == "swap" and len(stack) > 1:
        stack[-1], stack[-2] = stack[-2], stack[-1]
    elif move == "drop" and stack:
        stack.pop()
    if fails:
        c[:] = [math.nan] * 4
    return not fails


def by_point(operator: object) -> Op:
    """An array operator from one on points."""

    def over(f):
        def run(m, x, y, z, t):
            rows = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, y, z, t)))
            shape = rows[0].shape
            made = [f(c) for c in zip(*(r.ravel().tolist() for r in rows), strict=True)]
            table = np.array([c if c is not None else (math.nan,) * 4 for c in made], float).reshape(-1, 4)
            return tuple(table[:, k].reshape(shape) for k in range(4))

        return run

    back = getattr(operator, "inv", None)
    return Op(over(operator.fwd), over(back) if back else None, arrow=True)


def transform(df: DataFrame, text: str, x: str, y: str, **options) -> DataFrame:
    """Pipeline(text).transform(...) in one call."""
    return Pipeline(text, options.pop("context", None)).transform(df, x, y, **options)


def ok_count(column: str = "ok") -> Column:
    return F.count_if(F.col(column))
