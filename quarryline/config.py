"""Settings of the engine, from defaults, a YAML or JSON file, a mapping, and environment variables, later ones winning."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class EngineConfig:
    index_root: str = "/tmp/quarryline-index"
    index_prefix: str = "ql_"
    max_chunk_bytes: int = 5000
    overlap_bytes: int = 300
    min_chunk_bytes: int = 100
    whole_file_bytes: int = 4096
    max_content_bytes: int = 60000
    max_file_bytes: int = 1 << 20
    batch_files: int = 50
    batch_bytes: int = 5 << 20
    recall_floor: int = 30
    recall_factor: int = 3
    keyword_only_limit: int = 200
    hit_boost: float = 0.02
    hit_boost_cap: float = 0.20
    keyword_base: float = 0.30
    keyword_step: float = 0.015
    keyword_cap: float = 0.50
    default_top_k: int = 5
    max_top_k: int = 100
    embedding_dim: int = 256
    embedding_provider: str = "hashing"
    embedding_key: str = ""
    embedding_base: str = ""
    embedding_model: str = ""
    embedding_batch: int = 100
    requests_per_second: float = 0.0
    tokens_per_minute: int = 0
    tool_dir: str = ".quarryline"
    ignore_file: str = ".quarrylineignore"

    @classmethod
    def load(cls, values: Mapping | None = None, env: Mapping[str, str] | None = None, prefix: str = "QUARRYLINE_", file: str = "") -> EngineConfig:
        """Defaults, then the file, then values, then PREFIX + upper-case field names of the environment."""
        out = cls()
        known = {f.name: f for f in fields(cls)}
        for k, v in [*read_settings(file).items(), *(values or {}).items()]:
            if k in known and v is not None:
                out = replace(out, **{k: _typed(v, getattr(out, k))})
        for k in known:
            if v := (os.environ if env is None else env).get(prefix + k.upper()):
                out = replace(out, **{k: _typed(v, getattr(out, k))})
        return out

    def recall(self, top_k: int) -> int:
        return max(self.recall_floor, self.recall_factor * top_k)

    def top_k(self, asked: int | None) -> int:
        """The number of results for what was asked: the default where it isn't positive, at most max_top_k."""
        return self.default_top_k if not asked or asked <= 0 else min(asked, self.max_top_k)


def read_settings(path: str) -> dict:
    """Settings of a YAML file (JSON is YAML too); sections are flattened, as embedding: {dim: 8} gives embedding_dim. None without a path."""
    if not path:
        return {}
    with open(path, encoding="utf-8") as file:
        text = file.read()
    try:
        import yaml
    except ImportError:
        import json

        found = json.loads(text)
    else:
        found = yaml.safe_load(text)
    out: dict = {}

    def flatten(section: Mapping, start: str) -> None:
        for k, v in section.items():
            if isinstance(v, Mapping):
                flatten(v, f"{start}{k}_")
            else:
                out[f"{start}{k}"] = v

    flatten(found if isinstance(found, Mapping) else {}, "")
    return out


def _typed(value, like):
    return type(like)(value)


def first_set(*values: str | None, default: str = "") -> str:
    """The first value that is not empty: flag, environment, project, machine, default."""
    return next((v for v in values if v), default)
