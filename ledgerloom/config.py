"""Layered settings: defaults, then a file, then the environment, then what is given explicitly.

The file is the one given, else the first found in the search path: JSON, or YAML where a reader for it is installed. These are settings of the driver; tasks get their values.
"""

from __future__ import annotations

import json
import os
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from pathlib import Path

PREFIX = "LEDGERLOOM_"
#: Where a file is looked for, in this order; the last below the home folder.
NAMES = ("config/config.yaml", "config/config.yml", "config/config.json", "config.yaml", "config.yml", "config.json")
OWN = ".config/ledgerloom/config.yaml"


@dataclass(frozen=True)
class Settings:
    confidence_threshold: float = 0.8
    validation_threshold: float = 0.6
    duplicate_threshold: float = 0.95
    cache_cap_mb: int = 1000
    max_image_side: int = 2048
    dedupe: bool = True
    write_reports: bool = True
    include_raw_text: bool = False
    include_confidence: bool = True

    def checked(self) -> Settings:
        for name in ("confidence_threshold", "validation_threshold", "duplicate_threshold"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie between 0 and 1")
        if self.cache_cap_mb <= 0 or self.max_image_side <= 0:
            raise ValueError("sizes must be above 0")
        return self


def _typed(kind: str, value: str | float | bool) -> float | int | bool:
    if kind == "bool":
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
    return {"float": float, "int": int}[kind](value)


def found(folder: str | Path = ".", home: str | Path | None = None) -> Path | None:
    """The first file of the search path that is there."""
    paths = [*(Path(folder) / n for n in NAMES), Path(home or Path.home()) / OWN]
    return next((p for p in paths if p.is_file()), None)


def read_file(path: str | Path) -> dict:
    """The settings of a file, those of its sections among them. One that lacks or can't be read gives none, and a warning."""
    try:
        text = Path(path).read_text(encoding="utf-8")
        if Path(path).suffix.lower() in (".yaml", ".yml"):
            import yaml

            raw = yaml.safe_load(text)
        else:
            raw = json.loads(text)
        if not isinstance(raw, Mapping):
            raise ValueError("settings are names and values")
    except (OSError, ValueError, ImportError) as e:
        warnings.warn(f"settings of {path} are left out: {type(e).__name__}: {e}", stacklevel=2)
        return {}
    except Exception as e:  # the YAML reader's own errors
        warnings.warn(f"settings of {path} are left out: {e}", stacklevel=2)
        return {}
    flat = {k: v for k, v in raw.items() if not isinstance(v, Mapping)}
    for section in raw.values():
        flat |= {k: v for k, v in section.items() if k not in flat} if isinstance(section, Mapping) else {}
    return {k: v for k, v in flat.items() if v is not None}


def resolve(path: str | None = None, env: dict[str, str] | None = None, **explicit) -> Settings:
    """Only settings that are really given override those of an earlier layer. Without ``path`` the search path is used."""
    path = path or found()
    env = dict(os.environ) if env is None else env
    known = {f.name: str(f.type) for f in fields(Settings)}
    layers = [read_file(path) if path else {}, {k: env[PREFIX + k.upper()] for k in known if PREFIX + k.upper() in env}, {k: v for k, v in explicit.items() if v is not None}]
    out = Settings()
    for layer in layers:
        out = replace(out, **{k: _typed(known[k], v) for k, v in layer.items() if k in known})
    return out.checked()
