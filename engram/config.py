"""Settings, with their defaults."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Fork:
    prefix_step: int = 5
    max_windows: int = 8
    max_candidates_per_window: int = 20
    min_confidence: float = 0.3
    similarity_merge: float = 0.75
    similarity_relate: float = 0.50
    cluster_sim: float = 0.6
    hist_sim: float = 0.8
    route: str = "full2"

    def __post_init__(self) -> None:
        if self.route not in ("prefix", "non_prefix", "full", "full2"):
            raise ValueError(f"unknown route {self.route}")


@dataclass(frozen=True)
class Wiki:
    group_sim: float = 0.75
    max_hops: int = 3
    batch_size: int = 10


@dataclass(frozen=True)
class Recall:
    top_k: int = 8
    include_wiki: bool = True
    min_score: float = 0.30


@dataclass(frozen=True)
class Search:
    top_k: int = 3
    max_body_len: int = 4000


@dataclass(frozen=True)
class Namespaces:
    mode: str = "isolated"
    visible: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.mode not in ("isolated", "all", "custom"):
            raise ValueError(f"unknown mode {self.mode}")


@dataclass(frozen=True)
class Config:
    root: str = "memory"
    fork: Fork = Fork()
    wiki: Wiki = Wiki()
    recall: Recall = Recall()
    search: Search = Search()
    namespaces: Namespaces = Namespaces()
    log_retain: int = 0
    embedding_model: str = ""
    embedding_dimensions: int = 1024
    job_timeout_minutes: float = 45
    excluded_boards: tuple[str, ...] = ()
    wiki_enabled: bool = True
    mode: str = "both"  # what a client does: input (it pushes sessions), output (it reads), or both
    port: int = 8080

    def __post_init__(self) -> None:
        if self.mode not in ("both", "input", "output"):
            raise ValueError(f"unknown mode {self.mode}")


def load(text: str = "", env: dict[str, str] | None = None) -> Config:
    """JSON over the defaults; ENGRAM_ROOT, ENGRAM_MODE and ENGRAM_PORT override root, mode and port."""
    given = json.loads(text) if text.strip() else {}
    config = Config()
    for f in fields(Config):
        if f.name in given:
            old = getattr(config, f.name)
            new = replace(old, **given[f.name]) if isinstance(given[f.name], dict) else type(old)(given[f.name])
            config = replace(config, **{f.name: new})
    for f in ("root", "mode", "port"):
        if value := (os.environ if env is None else env).get(f"ENGRAM_{f.upper()}"):
            config = replace(config, **{f: type(getattr(config, f))(value)})
    return config
