"""Macros in files. `prefix:suffix` is the whole of `<folder>/resources/<prefix>_<suffix>.resource`, or a fenced block
of `<folder>/resources/<prefix>.md` whose opening line ends in `:<suffix>`. Registers of this package come last."""

from __future__ import annotations

import re
from functools import lru_cache
from pathlib import Path

BUNDLED = Path(__file__).resolve().parents[1] / "registers"
FENCE = re.compile(r"^```[\w-]*:([^\s`]+)[ \t]*\n(.*?)(?:^```|\Z)", re.MULTILINE | re.DOTALL)


def blocks(text: str) -> dict[str, str]:
    """Macros of a register, by suffix; of several with one name the first holds."""
    out: dict[str, str] = {}
    for suffix, body in FENCE.findall(text.replace("\r\n", "\n").replace("\r", "\n")):
        out.setdefault(suffix, body.strip())
    return out


@lru_cache(256)
def _read(path: str, changed: int) -> dict[str, str]:
    return blocks(Path(path).read_text(encoding="utf-8"))


def look_up(name: str, folders: list[str]) -> str | None:
    """The text of a macro, or None."""
    prefix, _, suffix = name.partition(":")
    if not re.fullmatch(r"[\w.-]+", prefix) or not re.fullmatch(r"[\w.-]+", suffix):
        return None
    for folder in [*(Path(f) / "resources" for f in folders), BUNDLED]:
        alone = folder / f"{prefix}_{suffix}.resource"
        if alone.is_file():
            return alone.read_text(encoding="utf-8").strip()
        register = folder / f"{prefix}.md"
        if register.is_file():
            found = _read(str(register), register.stat().st_mtime_ns).get(suffix)
            if found is not None:
                return found
    return None
