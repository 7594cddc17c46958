"""Settings from the environment, each with a default."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    store: str = "artifacts"
    progress_mode: str = "auto"
    reviewer_url: str = ""
    reviewer_model: str = ""
    reviewer_key: str = ""
    reviewer_timeout: int = 15
    reviewer_retries: int = 2

    @classmethod
    def read(cls, env: Mapping[str, str] | None = None) -> Settings:
        """FACTGRAPH_STORE, FACTGRAPH_PROGRESS_MODE, FACTGRAPH_REVIEWER_URL, _MODEL, _KEY, _TIMEOUT (seconds, above 0) and _RETRIES; empty or bad values keep the default."""
        env = os.environ if env is None else env
        found = {}
        for name, default in cls().__dict__.items():
            value = env.get(f"FACTGRAPH_{name.upper()}", "")
            if isinstance(default, int):
                if value.strip().lstrip("+").isdigit() and int(value) >= (1 if name == "reviewer_timeout" else 0):
                    found[name] = int(value)
            elif value:
                found[name] = value
        return cls(**found)
