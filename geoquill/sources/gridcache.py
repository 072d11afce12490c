"""Decoded grids, once in each process: in the driver, and in each of the executors' Python workers.

A plan carries handles. A handle of a file knows its path; a handle of a grid in memory knows a broadcast, made once for
the grid whatever the number of plans. Whoever needs the nodes asks here; grids used least recently go once their bytes
pass the limit. `clear` empties the driver's cache at once, and that of a worker when it next meets a handle made
since.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable

from pyspark import SparkContext

from .gridfiles import parse

LIMIT = 1 << 29
_held: OrderedDict[str, object] = OrderedDict()
_state = {"limit": LIMIT, "generation": 0, "decoded": 0}


def _bytes(grid: object) -> int:
    nodes = getattr(grid, "nodes", None)
    inner = [*getattr(grid, "parts", []), *(g for g in (getattr(grid, "flat", None), getattr(grid, "heights", None)) if g is not None)]
    return getattr(nodes, "nbytes", 0) + sum(map(_bytes, inner))


def limit(size: int) -> None:
    """Bytes of nodes that a process holds; handles carry it to the workers."""
    _state["limit"] = size
    _trim()


def _trim() -> None:
    while len(_held) > 1 and sum(map(_bytes, _held.values())) > _state["limit"]:
        _held.popitem(last=False)


def clear() -> None:
    _held.clear()
    _state["generation"] += 1


def decoded() -> int:
    """How often this process has decoded a grid, or unpacked one that was sent."""
    return _state["decoded"]


def get(key: str, make: Callable[[], object]) -> object:
    if key not in _held:
        _state["decoded"] += 1
        _held[key] = make()
    _held.move_to_end(key)
    _trim()
    return _held[key]


def _here(generation: int, size: int) -> None:
    """In a worker: what the driver has cleared since goes."""
    if generation > _state["generation"]:
        _held.clear()
        _state["generation"] = generation
    _state["limit"] = size


class Handle:
    """Stands for a grid; what operators ask of a grid, they may ask of this."""

    key: str

    def grid(self) -> object:
        raise NotImplementedError

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return getattr(self.grid(), name)


class Sent(Handle):
    """A grid in the driver's memory, sent to each executor once."""

    def __init__(self, grid: object):
        self.key, self._grid, self._broadcast, self._context = uuid.uuid4().hex, grid, None, None

    def grid(self) -> object:
        return self._grid

    def __reduce__(self):
        context = SparkContext._active_spark_context
        if context is None:
            return Sent, (self._grid,)
        if self._broadcast is None or self._context is not context:
            self._broadcast, self._context = context.broadcast(self._grid), context
        return Received, (self.key, self._broadcast, _state["generation"], _state["limit"])


class Received(Handle):
    def __init__(self, key: str, broadcast, generation: int, size: int):
        self.key, self._broadcast = key, broadcast
        _here(generation, size)

    def grid(self) -> object:
        return get(self.key, lambda: self._broadcast.value)


class InFile(Handle):
    """A grid file that every process reads for itself."""

    def __init__(self, path: str, name: str, changed: int, generation: int | None = None, size: int | None = None):
        self.key, self._path, self._name, self._changed = f"{path} {changed}", path, name, changed
        if generation is not None:
            _here(generation, size)

    def __reduce__(self):
        return InFile, (self._path, self._name, self._changed, _state["generation"], _state["limit"])

    def grid(self) -> object:
        from .griddata import opened

        return get(self.key, lambda: parse(self._name, opened(self._path)[:]))
