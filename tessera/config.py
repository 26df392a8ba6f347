"""Settings from a TOML file, overridden by the environment, overridden by arguments.  No value has a default in code."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Settings:
    values: Mapping[str, Any]

    def __getitem__(self, path: str) -> Any:
        at: Any = self.values
        for part in path.split("."):
            if not isinstance(at, Mapping) or part not in at:
                raise KeyError(f"setting {path} is missing")
            at = at[part]
        return at


def _merge(base: dict, top: Mapping) -> dict:
    out = dict(base)
    for k, v in top.items():
        out[k] = _merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), dict) else v
    return out


def load(toml: str, environ: Mapping[str, str] | None = None, prefix: str = "TESSERA__", **overrides: Any) -> Settings:
    """``toml`` text; variables ``PREFIX`` + path with ``__`` between its parts; keyword overrides win."""
    values: dict = tomllib.loads(toml)
    for name, text in (os.environ if environ is None else environ).items():
        if name.startswith(prefix):
            nested: Any = text
            for part in reversed(name[len(prefix) :].lower().split("__")):
                nested = {part: nested}
            values = _merge(values, nested)
    return Settings(_merge(values, overrides))
