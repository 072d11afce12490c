"""The pipeline language: steps between bars, parameters, macros, arguments with defaults, prefix modifiers."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MODIFIERS = ("inv", "omit_fwd", "omit_inv")
SUBSCRIPTS = dict(zip("₀₁₂₃₄₅₆₇₈₉", "0123456789", strict=True))
DEEPEST = 100


class PipelineError(ValueError):
    """A definition that can't be understood or instantiated."""


def normalize(text: str) -> str:
    """Comments off, white space and separators in one form, `>` and `<` as modifiers of the step they open."""
    lines = (line.split("#", 1)[0] for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"))
    text = " ".join(line.strip().lstrip(":").strip() for line in lines).strip().strip(":")
    text = re.sub(r"\s+", " ", text)
    text = re.sub(r"\s*([=:,|<>])\s*", r"\1", text)
    text = text.replace(">", "|omit_inv ").replace("<", "|omit_fwd ").replace("$ ", "$")
    text = re.sub("([₀-₉])=", lambda m: f"_{SUBSCRIPTS[m[1]]}=", text)
    return re.sub(r"\s+", " ", text).strip()


@dataclass
class Step:
    """A step as written: operator or macro name, and its arguments as text."""

    name: str
    given: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def parse(text: str) -> Step:
        words = text.split()
        while words and words[0] in MODIFIERS and any(w not in MODIFIERS for w in words):
            words.append(words.pop(0))
        name, *rest = words
        pairs = (w.split("=", 1) if "=" in w else (w, "true") for w in rest)
        return Step(name.split("=")[0], {k: v for k, v in pairs})

    def flag(self, key: str) -> bool:
        value = self.given.get(key)
        if value in (None, "false"):
            return False
        if value in ("", "true"):
            return True
        raise PipelineError(f"{self.name}: {key} is a flag")


def split(text: str) -> list[Step]:
    return [Step.parse(s) for s in normalize(text).split("|") if s.strip()]


def chase(key: str, value: str, outer: dict[str, str], name: str) -> str:
    """A value with references resolved: `$name` and `$name(default)` look into the caller's arguments, `(default)`
    holds unless the caller gives the key itself."""
    for _ in range(DEEPEST):
        if value.startswith("(") and value.endswith(")"):
            if key in outer:
                value = outer[key]
                continue
            return value[1:-1]
        if not value.startswith("$"):
            return value
        wanted, _, default = value[1:].partition("(")
        if wanted in outer:
            value = outer[wanted]
        elif default:
            return default.rstrip(")")
        else:
            raise PipelineError(f"{name}: nothing is given for ${wanted}")
    raise PipelineError(f"{name}: references without end")


def expand(text: str, macros, outer: dict[str, str] | None = None, depth: int = 0) -> list[Step]:
    """Steps with all macros expanded and arguments resolved. `macros` maps a name with a colon to its text."""
    if depth > DEEPEST:
        raise PipelineError(f"recursion: {text[:60]}")
    outer = outer or {}
    out: list[Step] = []
    for step in split(text):
        given = {k: chase(k, v, outer, step.name) for k, v in step.given.items()}
        step = Step(step.name, given)
        if step.name == "pipeline":
            raise PipelineError("a pipeline can't be a step")
        if ":" not in step.name:
            # a macro's arguments are seen by its steps, where these don't set them
            out.append(Step(step.name, {k: v for k, v in outer.items() if k not in MODIFIERS} | given))
            continue
        body = macros(step.name)
        if body is None:
            raise PipelineError(f"no macro {step.name}")
        inner = expand(body, macros, outer | {k: v for k, v in given.items() if k not in MODIFIERS}, depth + 1)
        if step.flag("inv"):
            inner = [inverted(s) for s in reversed(inner)]
        for s in inner:
            for key in ("omit_fwd", "omit_inv"):
                if step.flag(key):
                    s.given[key] = "true"
        out += inner
    return out


def inverted(step: Step) -> Step:
    given = dict(step.given)
    if step.flag("inv"):
        del given["inv"]
    else:
        given["inv"] = "true"
    forward, back = given.pop("omit_fwd", None), given.pop("omit_inv", None)
    if back is not None:
        given["omit_fwd"] = back
    if forward is not None:
        given["omit_inv"] = forward
    return Step(step.name, given)
