"""Settings as nested dictionaries: defaults, a pack's file and overrides, merged in that order."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path
from typing import Any

DEFAULTS: dict[str, Any] = {
    "chunk": {"target": 120, "overlap": 20, "least": 5},
    "search": {"keyword": 30, "vector": 30, "fused": 20, "top": 5, "rrf": 60.0, "widen": 2},
    "tags": {"confidence": 0.5, "boost": 0.25, "synonyms": {}, "intents": {}},
    "statements": {"titles": {}, "keywords": {}, "numbers": 15, "slots": 2, "keep": 3},
    "gate": {"sufficient": 0.0, "partial": 0.0, "mode": "rerank"},
    "answer": {"tokens": 256, "hedges": []},
    "sections": [],
}
REQUIRED = ("chunk.target", "search.top", "gate.sufficient")


def merge(base: Mapping[str, Any], *over: Mapping[str, Any]) -> dict[str, Any]:
    """A new dictionary in which later values replace earlier ones; dictionaries are merged key by key."""
    out = dict(base)
    for layer in over:
        for k, v in layer.items():
            old = out.get(k)
            out[k] = merge(old, v) if isinstance(old, Mapping) and isinstance(v, Mapping) else v
    return out


def get(config: Mapping[str, Any], path: str, default: Any = None) -> Any:
    """The value at a path of keys with points between them."""
    for key in path.split("."):
        if not isinstance(config, Mapping) or key not in config:
            return default
        config = config[key]
    return config


def load(pack: str | Path | None = None, overrides: Mapping[str, Any] | None = None, defaults: Mapping[str, Any] = DEFAULTS) -> dict[str, Any]:
    """Defaults, then the pack's YAML file, then overrides; an error where a required value is missing or null."""
    layers = [overrides or {}]
    if pack is not None:
        import yaml

        layers.insert(0, yaml.safe_load(Path(pack).read_text(encoding="utf-8")) or {})
    out = merge(defaults, *layers)
    if missing := [p for p in REQUIRED if get(out, p) is None]:
        raise KeyError(f"missing settings: {', '.join(missing)}")
    return out
