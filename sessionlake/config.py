"""Settings: command line over environment over TOML file over defaults; unknown keys are errors."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any

from .functions.text import glob
from .schema import AGENTS, parse_agent

PREFIX = "SESSIONLAKE_"
FORMATS = ("text", "json", "jsonl", "markdown")
TOKENIZERS = ("unicode61", "segment")


@dataclass(frozen=True)
class Config:
    database_path: str = "sessionlake-archive"
    default_agents: tuple[str, ...] = AGENTS
    capture_mode: str = "full"
    exclude: tuple[str, ...] = ()
    tokenizer: str = "unicode61"
    tokenizer_extension: str | None = None
    output_format: str = "text"
    watch_interval_seconds: int = 300
    watch_debounce_ms: int = 1000

    def __post_init__(self):
        object.__setattr__(self, "default_agents", tuple(parse_agent(a) for a in self.default_agents))
        object.__setattr__(self, "output_format", {"md": "markdown"}.get(self.output_format, self.output_format))
        for name, allowed in (("output_format", FORMATS), ("tokenizer", TOKENIZERS), ("capture_mode", ("partial", "full"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} {getattr(self, name)!r} is not one of {', '.join(allowed)}")
        if self.tokenizer_extension and self.tokenizer != "segment":
            raise ValueError("tokenizer_extension needs tokenizer = segment")
        if self.watch_interval_seconds < 1 or self.watch_debounce_ms < 0:
            raise ValueError("watch times must be positive")
        for g in self.exclude:
            glob(g)


def _typed(name: str, value: Any) -> Any:
    default = {f.name: f for f in fields(Config)}[name].default
    if isinstance(default, tuple):
        return tuple(v.strip() for v in value.split(",") if v.strip()) if isinstance(value, str) else tuple(value)
    return int(value) if isinstance(default, int) else value


def resolve(args: dict[str, Any] | None = None, env: dict[str, str] | None = None, file: str | None = None) -> Config:
    names = {f.name for f in fields(Config)}
    layer: dict[str, Any] = {}
    if file:
        found = tomllib.loads(Path(file).read_text())
        if odd := sorted(found.keys() - names):
            raise ValueError(f"unknown settings in {file}: {', '.join(odd)}")
        layer |= found
    env = os.environ if env is None else env
    layer |= {n: env[PREFIX + n.upper()] for n in names if PREFIX + n.upper() in env}
    layer |= {k: v for k, v in (args or {}).items() if v is not None}
    return Config(**{k: _typed(k, v) for k, v in layer.items()})
