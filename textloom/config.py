"""Settings of a collection: folders, names of models, and what its providers need; a check of both."""

from __future__ import annotations

import importlib.util
import os
import sys
from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    """Folders stand under `root`, which may be any path that Spark reads; keys come from the environment."""

    root: str = "data"
    encoder: str = "hashed"
    providers: tuple[str, ...] = ()
    environment: Mapping[str, str] = field(default_factory=lambda: dict(os.environ))

    def path(self, *parts: str) -> str:
        return "/".join((self.root.rstrip("/"), *parts))

    @property
    def raw(self) -> str:
        return self.path("raw")

    @property
    def manifest(self) -> str:
        return self.path("manifest.json")

    @property
    def index(self) -> str:
        return self.path("index")

    @property
    def cache(self) -> str:
        return self.path("cache")

    @property
    def results(self) -> str:
        return self.path("results")

    def key(self, provider: str) -> str | None:
        """A provider's key, from the variable <PROVIDER>_API_KEY; None where it is unset or blank."""
        return (self.environment.get(f"{provider.upper()}_API_KEY") or "").strip() or None


def doctor(config: Config, needed: tuple[str, ...] = ("raw", "index", "results")) -> tuple[list[str], int]:
    """What is there and what is missing, line by line, and an exit code: 1 if a needed local folder or library is missing."""
    lines, missing = [f"Python {sys.version.split()[0]}"], 0
    for library in ("pyspark", "pyarrow", "numpy", "pandas"):
        found = importlib.util.find_spec(library) is not None
        missing += not found
        lines.append(f"{library}: {'found' if found else 'MISSING'}")
    lines += [f"{p}: {'key set' if config.key(p) else 'no key'}" for p in config.providers]
    for name in needed:
        path = getattr(config, name)
        found = "://" in path or os.path.isdir(path)
        missing += not found
        lines.append(f"{path}: {'found' if found else 'MISSING'}")
    return lines, int(missing > 0)
