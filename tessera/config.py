"""Configuration of an index."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from tessera.schema import HYBRID_VECTORS

MODES = ("RAM", "HYBRID", "DISK")


@dataclass
class Config:
    memory_mode: str = "RAM"
    hybrid_limit: int = HYBRID_VECTORS
    embedding_model: str = "all-minilm"
    embedding_backend: str = "ollama"
    openai_key: str = ""
    watch_paths: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Config:
        """Fields that are missing or of a wrong type keep their default; a file that can't be read gives the defaults."""
        c = cls()
        try:
            with open(path) as f:
                raw = json.load(f)
        except (OSError, ValueError):
            return c
        for k, v in raw.items() if isinstance(raw, dict) else ():
            if hasattr(c, k) and isinstance(v, type(getattr(c, k))):
                setattr(c, k, v)
        if c.memory_mode not in MODES:
            c.memory_mode = "RAM"
        return c

    def save(self, path: str) -> None:
        d = dict(vars(self))
        if not d["openai_key"]:
            del d["openai_key"]
        with open(path, "w") as f:
            json.dump(d, f, indent=4)
