"""Configuration: YAML or JSON files with ``${VAR:-default}`` -> typed settings. Unknown keys are errors."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
import re
from dataclasses import dataclass, field
from pathlib import Path

from docloom.functions.clean import CleanOptions, TextCleaner
from docloom.functions.normalize import NormalizeOptions, PreprocessorChain, TextNormalizer
from docloom.operators import chunking


@dataclass(frozen=True)
class ChunkerSettings:
    strategy: str = "recursive"
    chunk_size: int = 1000
    chunk_overlap: int = 200
    min_chunk_size: int = 100
    separators: tuple[str, ...] = chunking.SEPARATORS
    semantic_threshold: float = 0.5

    def column(self, c, embed=None):
        """The chunk array of a text column. Sliding steps by size - overlap; separators reach only the recursive chunker."""
        size, overlap, least = self.chunk_size, self.chunk_overlap, min(self.min_chunk_size, self.chunk_size)
        build = {
            "recursive": lambda: chunking.recursive(c, size, overlap, least, tuple(self.separators)),
            "fixed": lambda: chunking.fixed(c, size, overlap, least),
            "token": lambda: chunking.token(c, size, overlap),
            "sentence": lambda: chunking.sentence(c, size, overlap),
            "paragraph": lambda: chunking.paragraph(c, size, overlap),
            "semantic": lambda: chunking.semantic(c, embed, self.semantic_threshold, least, size),
            "sliding": lambda: chunking.sliding(c, size, size - overlap),
        }
        if self.strategy not in build:
            raise ValueError(f"unknown chunking strategy: {self.strategy}")
        return build[self.strategy]()


@dataclass(frozen=True)
class Settings:
    parser: dict[str, dict] = field(default_factory=dict)
    cleaner: CleanOptions = field(default_factory=CleanOptions)
    normalizer: NormalizeOptions = field(default_factory=NormalizeOptions)
    chunker: ChunkerSettings = field(default_factory=ChunkerSettings)
    error_strategy: str = "skip"

    def chain(self) -> PreprocessorChain:
        return PreprocessorChain(TextCleaner(self.cleaner), TextNormalizer(self.normalizer))


def expand_env(value):
    """``${VAR}`` and ``${VAR:-default}`` in all strings; an unset variable without default is empty."""
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: os.environ.get(m[1], m[2] or ""), value)
    if isinstance(value, dict):
        return {k: expand_env(v) for k, v in value.items()}
    return [expand_env(v) for v in value] if isinstance(value, list) else value


def _build(kind, values: dict):
    names = {f.name for f in dataclasses.fields(kind)}
    if unknown := set(values) - names:
        raise ValueError(f"unknown keys for {kind.__name__}: {', '.join(sorted(unknown))}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def from_dict(values: dict) -> Settings:
    values = expand_env(values)
    parts = {"cleaner": CleanOptions, "normalizer": NormalizeOptions, "chunker": ChunkerSettings}
    out = _build(Settings, {k: _build(parts[k], v) if k in parts else v for k, v in values.items()})
    if out.error_strategy not in ("skip", "log", "raise"):
        raise ValueError(f"unknown error strategy: {out.error_strategy}")
    return out


def load(path: str) -> Settings:
    text, suffix = Path(path).read_text("utf-8"), Path(path).suffix.lower()
    if suffix in (".yaml", ".yml"):
        import yaml  # optional

        return from_dict(yaml.safe_load(text) or {})
    if suffix == ".json":
        return from_dict(json.loads(text))
    raise ValueError(f"unknown kind of configuration: {suffix}")


def save(settings: Settings, path: str) -> None:
    values = dataclasses.asdict(settings)
    if Path(path).suffix.lower() in (".yaml", ".yml"):
        import yaml  # optional

        Path(path).write_text(yaml.safe_dump(json.loads(json.dumps(values))), "utf-8")
    else:
        Path(path).write_text(json.dumps(values, indent=2, ensure_ascii=False), "utf-8")


def config_hash(values: dict) -> str:
    """Eight hexadecimal digits of the MD5 of the sorted JSON."""
    return hashlib.md5(json.dumps(values, sort_keys=True).encode()).hexdigest()[:8]


#: Name -> (strategy, size, overlap) of the configurations a benchmark starts with.
DEFAULT_CONFIGS = {
    "fast_basic": ("fixed", 512, 0), "balanced": ("fixed", 512, 50), "high_quality": ("fixed", 400, 80), "small_chunks": ("fixed", 256, 50), "large_chunks": ("fixed", 1024, 100),
}


def default_configs() -> dict[str, ChunkerSettings]:
    return {k: ChunkerSettings(s, n, o) for k, (s, n, o) in DEFAULT_CONFIGS.items()}
