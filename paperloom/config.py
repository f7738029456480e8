"""Settings, from the environment where it has them."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from functools import lru_cache


@dataclass(frozen=True)
class Config:
    data_dir: str = "data"
    render_dpi: int = 300
    preview_dpi: int = 130
    crop_dpi: int = 200
    vision_provider: str = "mock"
    vision_fallback: str = ""
    vision_second: str = ""
    vision_concurrency: int = 5
    vision_retries: int = 2
    vision_backoff_s: float = 2.0

    @property
    def uploads(self) -> str:
        return f"{self.data_dir}/uploads"

    @property
    def tables(self) -> str:
        return f"{self.data_dir}/tables"


@lru_cache(1)
def get_config(prefix: str = "PAPERLOOM_") -> Config:
    """Each field may be set by a variable of its name in capitals after ``prefix``."""
    kinds = {"int": int, "float": float, "str": str}
    found = {f.name: kinds[f.type](os.environ[prefix + f.name.upper()]) for f in fields(Config) if prefix + f.name.upper() in os.environ}
    return Config(**found)
