"""Settings, as frozen dataclasses that check themselves. The defaults are fixed values of the scores."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path


class ConfigError(ValueError):
    """Settings that can't be used."""


def _units(**values: float) -> None:
    for k, v in values.items():
        if not 0 <= v <= 1:
            raise ConfigError(f"{k} must lie in [0, 1], not {v}")


def _positive(**values: int) -> None:
    for k, v in values.items():
        if v < 1:
            raise ConfigError(f"{k} must be 1 at least, not {v}")


@dataclass(frozen=True)
class Detect:
    detectors: tuple[str, ...] = ("classical", "stylometric", "statistical")
    ai_likely: float = 0.62
    watermark_likely: float = 0.70
    uncertain: float = 0.45
    window_tokens: int = 256
    window_stride: int = 128

    def __post_init__(self) -> None:
        _units(ai_likely=self.ai_likely, watermark_likely=self.watermark_likely, uncertain=self.uncertain)
        _positive(window_tokens=self.window_tokens, window_stride=self.window_stride)


@dataclass(frozen=True)
class Quality:
    min_similarity: float = 0.82
    min_readability: float = 20.0
    max_length_ratio: float = 1.45
    min_length_ratio: float = 0.62
    target_ai_score: float = 0.40
    target_watermark_score: float = 0.48

    def __post_init__(self) -> None:
        _units(min_similarity=self.min_similarity, target_ai_score=self.target_ai_score, target_watermark_score=self.target_watermark_score)


@dataclass(frozen=True)
class Settings:
    detect: Detect = field(default_factory=Detect)
    quality: Quality = field(default_factory=Quality)
    protect_tables: bool = True
    seed: int = 13


#: Where settings are looked for when no path is given, in this order.
NAMES = tuple(f"inkgauge.{end}" for end in ("toml", "yaml", "yml", "json"))


def discover(path: str | os.PathLike | None = None) -> Path | None:
    """The file to read: path (which must be there), else the first of NAMES in the working directory or ~/.config/inkgauge."""
    if path is not None:
        if not Path(path).is_file():
            raise ConfigError(f"{path}: no such file")
        return Path(path)
    return next((d / n for d in (Path.cwd(), Path.home() / ".config/inkgauge") for n in NAMES if (d / n).is_file()), None)


def _read(path: Path) -> dict:
    raw = path.read_text()
    if path.suffix in (".yaml", ".yml"):
        import yaml

        try:
            data = yaml.safe_load(raw) or {}
        except yaml.YAMLError as e:
            raise ConfigError(f"{path}: {e}") from e
    else:
        data = json.loads(raw) if path.suffix == ".json" else tomllib.loads(raw)
    if not isinstance(data, dict):
        raise ConfigError(f"{path}: must be a mapping")
    return data


def load(path: str | os.PathLike | None = None) -> Settings:
    """Settings of a TOML, YAML or JSON file, or the defaults; anything that can't be used is a ConfigError."""
    found = discover(path)
    if found is None:
        return Settings()
    try:
        data, out = _read(found), Settings()
        if unknown := data.keys() - {f.name for f in fields(Settings)}:
            raise ConfigError(f"{found}: unknown settings {sorted(unknown)}")
        for f in fields(Settings):
            if f.name in data:
                part = getattr(out, f.name)
                value = {k: tuple(v) if isinstance(v, list) else v for k, v in data[f.name].items()} if isinstance(data[f.name], dict) else data[f.name]
                out = replace(out, **{f.name: replace(part, **value) if isinstance(value, dict) else value})
        return out
    except ConfigError:
        raise
    except (OSError, ValueError, TypeError, ImportError) as e:
        raise ConfigError(f"{found}: {e}") from e
