"""Typed access to a step's arguments."""

from __future__ import annotations

import math
from dataclasses import dataclass

from ..functions import angles
from ..functions.ellipsoid import Ellipsoid
from .language import PipelineError, Step


@dataclass
class Params:
    step: Step
    context: object = None

    def __contains__(self, key: str) -> bool:
        return key in self.step.given

    def flag(self, key: str) -> bool:
        return self.step.flag(key)

    def text(self, key: str, default: str | None = None) -> str:
        if key in self.step.given:
            return self.step.given[key]
        if default is None:
            raise PipelineError(f"{self.step.name}: {key} is missing")
        return default

    def real(self, key: str, default: float | None = None) -> float:
        if key not in self.step.given:
            if default is None:
                raise PipelineError(f"{self.step.name}: {key} is missing")
            return default
        value = angles.parse(self.step.given[key])
        if math.isnan(value) and self.step.given[key].lower() != "nan":
            raise PipelineError(f"{self.step.name}: {key} is no number: {self.step.given[key]}")
        return value

    def angle(self, key: str, default: float | None = None) -> float:
        """Degrees given, radians returned."""
        return math.radians(self.real(key, default))

    def natural(self, key: str, default: int | None = None) -> int:
        value = self.real(key, default)
        if value < 0 or value != int(value):
            raise PipelineError(f"{self.step.name}: {key} is no natural number")
        return int(value)

    def series(self, key: str, default: tuple[float, ...] | None = None) -> tuple[float, ...]:
        if key not in self.step.given:
            if default is None:
                raise PipelineError(f"{self.step.name}: {key} is missing")
            return default
        values = tuple(angles.parse(v) for v in self.step.given[key].split(","))
        if any(map(math.isnan, values)):
            raise PipelineError(f"{self.step.name}: {key} is no list of numbers")
        return values

    def texts(self, key: str, default: list[str] | None = None) -> list[str]:
        if key not in self.step.given:
            if default is None:
                raise PipelineError(f"{self.step.name}: {key} is missing")
            return default
        return [t.strip() for t in self.step.given[key].split(",")]

    def one_of(self, *keys: str, default: str | None = None) -> str:
        """The only flag given among these."""
        given = [k for k in keys if self.flag(k)]
        if len(given) > 1 or not given and default is None:
            raise PipelineError(f"{self.step.name}: one of {', '.join(keys)} is needed")
        return given[0] if given else default

    def ellps(self, key: str = "ellps", default: str = "GRS80") -> Ellipsoid:
        """Named, or "a,rf"; or from a (or R) with rf, f or b."""
        given = self.step.given
        if key == "ellps" and "ellps" not in given and ("a" in given or "R" in given):
            a = self.real("a") if "a" in given else self.real("R")
            if "rf" in given:
                return Ellipsoid.named(f"{a!r},{self.real('rf')!r}")
            f = self.real("f") if "f" in given else 1 - self.real("b") / a if "b" in given else 0.0
            return Ellipsoid(a, f)
        try:
            return Ellipsoid.named(self.text(key, default))
        except ValueError as e:
            raise PipelineError(f"{self.step.name}: {e}") from None

    # -- the parameters that every projection has
    @property
    def lat_0(self) -> float:
        return self.angle("lat_0", 0.0)

    @property
    def lon_0(self) -> float:
        return self.angle("lon_0", 0.0)

    @property
    def x_0(self) -> float:
        return self.real("x_0", 0.0)

    @property
    def y_0(self) -> float:
        return self.real("y_0", 0.0)

    @property
    def k_0(self) -> float:
        return self.real("k_0", self.real("k", 1.0))

    def fail(self, why: str) -> PipelineError:
        return PipelineError(f"{self.step.name}: {why}")
