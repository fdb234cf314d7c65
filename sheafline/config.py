"""Settings: defaults, then a YAML file, then the environment, then what the caller overrides."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace

#: Variables ``SHEAFLINE__<SECTION>__<NAME>`` override settings.
PREFIX = "SHEAFLINE__"


@dataclass(frozen=True)
class Retrieval:
    target_namespace: str = "target"
    global_namespace: str = "global"
    query_layers: tuple[str, ...] = ("fact", "evidence", "intro_doc", "raw_text", "meta")
    retrieval_mode: str = "flat"
    vector_top_k: int = 40
    rerank_top_n: int = 10


@dataclass(frozen=True)
class Agent:
    max_repair_attempts: int = 2
    confidence_threshold: float = 0.72
    human_review_threshold: float = 0.55


@dataclass(frozen=True)
class Services:
    embedding_model: str = "hashing"
    rerank_model: str = "lexical"
    chat_model: str = "offline"


@dataclass(frozen=True)
class Writeback:
    mode: str = "safe"
    write_comments: bool = True


@dataclass(frozen=True)
class Settings:
    retrieval: Retrieval = field(default_factory=Retrieval)
    agent: Agent = field(default_factory=Agent)
    services: Services = field(default_factory=Services)
    writeback: Writeback = field(default_factory=Writeback)

    def to_dict(self) -> dict:
        return asdict(self)


def scalar(text: str):
    """A value as JSON would read it, else the text."""
    try:
        return json.loads(text)
    except ValueError:
        return {"true": True, "false": False, "none": None}.get(text.strip().lower(), text)


def merged(settings, changes: Mapping):
    """``settings`` with the changes that name its fields; nulls and unknown names change nothing."""
    known = {f.name: getattr(settings, f.name) for f in fields(settings)}
    out = {}
    for name, value in changes.items():
        if name in known and value is not None:
            old = known[name]
            out[name] = merged(old, value) if is_dataclass(old) else tuple(value) if isinstance(old, tuple) else type(old)(value)
    return replace(settings, **out)


def load(path: str | None = None, env: Mapping[str, str] | None = None, overrides: Mapping | None = None) -> Settings:
    settings = Settings()
    if path:
        import yaml

        with open(path, encoding="utf-8") as f:
            settings = merged(settings, yaml.safe_load(f) or {})
    found: dict[str, dict] = {}
    for name, value in (os.environ if env is None else env).items():
        parts = name.removeprefix(PREFIX).lower().split("__")
        if name.startswith(PREFIX) and len(parts) == 2:
            found.setdefault(parts[0], {})[parts[1]] = scalar(value)
    return merged(merged(settings, found), overrides or {})
