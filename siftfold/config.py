"""Options, presets, and loading them from a file and the environment."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from siftfold.model import ConfigurationError

MODES = ("report", "remove", "interactive")
ENV_PREFIX = "SIFTFOLD_"


@dataclass(frozen=True)
class Config:
    max_depth: int | None = None
    min_file_size: int = 1024
    threads_per_stage: int = field(default_factory=lambda: os.cpu_count() or 1)
    quick_check_sample_size: int = 8192
    similarity_threshold: int = 95
    mode: str = "report"
    parallel_scan: bool = False
    extensions: tuple[str, ...] = ()
    hash_algorithm: str = "sha256"
    include_types: tuple[str, ...] = ()
    exclude_types: tuple[str, ...] = ()
    exclude_directories: tuple[str, ...] = ()

    def validate(self) -> Config:
        if not 0 <= self.similarity_threshold <= 100:
            raise ConfigurationError("similarity_threshold is a percentage, from 0 to 100")
        if self.threads_per_stage <= 0:
            raise ConfigurationError("threads_per_stage must be positive")
        if self.quick_check_sample_size <= 0:
            raise ConfigurationError("quick_check_sample_size must be positive")
        if self.mode not in MODES:
            raise ConfigurationError(f"mode must be one of {', '.join(MODES)}")
        return self

    @classmethod
    def load(cls, path: str | None = None, env: dict[str, str] | None = None) -> Config:
        """Defaults, then a YAML or JSON file, then environment variables."""
        given: dict = {}
        if path:
            try:
                text = Path(path).read_text(encoding="utf-8")
            except OSError as e:
                raise ConfigurationError(f"cannot read {path}: {e}") from e
            if path.endswith(".json"):
                given = json.loads(text)
            else:
                try:
                    import yaml
                except ImportError as e:
                    raise ConfigurationError("YAML files need the yaml module") from e
                given = yaml.safe_load(text) or {}
        env = os.environ if env is None else env
        given |= {k[len(ENV_PREFIX) :].lower(): v for k, v in env.items() if k.startswith(ENV_PREFIX)}
        out = {}
        for f in fields(cls):
            if f.name in given:
                out[f.name] = _typed(f.name, given[f.name])
        return replace(cls(), **out).validate()


def _typed(name: str, value):
    try:
        if name in ("extensions", "include_types", "exclude_types", "exclude_directories"):
            return tuple(value.split(",")) if isinstance(value, str) else tuple(value)
        if name == "parallel_scan":
            return value if isinstance(value, bool) else str(value).lower() in ("1", "true", "yes")
        if name in ("mode", "hash_algorithm"):
            return str(value).lower()
        return None if value is None else int(value)
    except (TypeError, ValueError) as e:
        raise ConfigurationError(f"{name}: {value!r}") from e


@dataclass(frozen=True)
class Preset:
    """What a performance mode sets: partitions for each core, sample size, files a trigger, rows an Arrow batch."""

    partitions_per_core: int
    sample_size: int
    max_files_per_trigger: int
    arrow_batch: int


@dataclass(frozen=True)
class WalkerPreset:
    """Of the stream reader: files a batch, seconds to a batch's deadline, partitions for each core."""

    files_per_batch: int
    deadline: float
    partitions_per_core: int


WALKERS = {"default": WalkerPreset(1000, 1.0, 2), "large": WalkerPreset(100_000, 5.0, 4), "responsive": WalkerPreset(100, 0.1, 1)}
PRESETS = {"high": Preset(4, 8192, 100_000, 1000), "balanced": Preset(2, 4096, 50_000, 500), "standard": Preset(1, 2048, 20_000, 200)}


@dataclass(frozen=True)
class BatchOptions:
    """Of the batch stages. Block size and numbers, sample sizes, limits, threshold."""

    block_size: int = 4096
    min_blocks: int = 10
    max_blocks: int = 1000
    similarity_threshold: float = 85.0
    header_size: int = 4096
    footer_size: int = 1024
    max_file_size: int = 10 << 30
