"""Settings of the operators, as frozen dataclasses with the tuned defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path

#: The lexicon categories, in order, and all subtypes.
CATEGORIES = ("porn", "politics", "abuse")
SUBTYPES = (*CATEGORIES, "other")


#: Keys of configuration files that are named otherwise here. The defaults of the classes below are fixed values too.
RENAMED = {"base_sensitive_prob": "base_prob", "max_sensitive_prob": "max_prob", "min_matches_for_sensitive": "min_matches"}


@dataclass(frozen=True)
class CleanConfig:
    min_length: int = 5
    max_length: int | None = None
    url_handling: str = "replace"
    url_placeholder: str = "[URL]"
    mention_handling: str = "replace"
    mention_placeholder: str = "[MENTION]"
    retweet_handling: str = "extract"


@dataclass(frozen=True)
class KnowledgeConfig:
    porn_weight: float = 1.0
    politics_weight: float = 0.6
    abuse_weight: float = 0.5
    base_prob: float = 0.17
    max_prob: float = 0.82
    min_matches: int = 1
    use_regex: bool = False


@dataclass(frozen=True)
class FusionConfig:
    alpha_grid: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)
    metric: str = "f1"
    n_buckets: int = 10
    lut_points: int = 100
    threshold_grid: tuple[float, ...] = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


@dataclass(frozen=True)
class SplitConfig:
    train: float = 0.8
    dev: float = 0.1
    test: float = 0.1
    seed: int = 42

    def __post_init__(self):
        if abs(self.train + self.dev + self.test - 1) > 1e-6:
            raise ValueError("ratios must sum to 1")


def load(cls, path: str | None = None, section: str | None = None, **given):
    """A config from defaults, then the YAML file's section, then what is given (None doesn't count)."""
    found: dict = {}
    if path and Path(path).exists():
        import yaml  # only where a file is read

        data = yaml.safe_load(Path(path).read_text("utf-8")) or {}
        found = data.get(section, {}) if section else data
    found = {RENAMED.get(k, k): v for k, v in found.items()}
    names = {f.name for f in fields(cls)}
    values = {k: v for k, v in {**found, **{k: v for k, v in given.items() if v is not None}}.items() if k in names}
    return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def load_env(path: str, environ: dict) -> None:
    """KEY=VALUE lines of a file into ``environ``, for keys that are unset."""
    if not Path(path).exists():
        return
    for line in Path(path).read_text("utf-8").splitlines():
        key, eq, value = line.strip().partition("=")
        if eq and not key.startswith("#"):
            environ.setdefault(key.strip(), value.strip().strip("\"'"))
