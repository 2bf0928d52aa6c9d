"""Small driver-side JSON records: configuration, progress, metadata."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile

#: Keys of a run configuration that are accepted and have no effect, and names that stand for another.
IGNORED_KEYS = ("val_split", "early_stopping", "early_stopping_patience", "resume", "resume_from")
ALIASES = {"save_dir": "output_dir"}


def atomic_json(path: str, value: object) -> None:
    """Writes through a temporary name in the same folder, so a reader sees the old or the new record."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=folder, suffix=".tmp")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
    os.replace(tmp, path)


def read_json(path: str) -> object | None:
    """A record, or None if it is missing or broken."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return None


def coerce_config(payload: dict, known: tuple[str, ...]) -> dict:
    """Known settings of a payload, aliases resolved; ignored and unknown keys go."""
    out = {}
    for k, v in payload.items():
        k = ALIASES.get(k, k)
        if k in known and k not in IGNORED_KEYS:
            out[k] = v
    return out


def normalise_config(cfg: dict) -> dict:
    """Clamped packing settings; ``chunk_size``, if set, replaces the window."""
    out = dict(cfg)
    if out.get("chunk_size"):
        out["max_seq_length"] = int(out["chunk_size"])
    out["max_seq_length"] = max(1, int(out.get("max_seq_length", 1024)))
    out["tokenized_shard_size"] = max(100, int(out.get("tokenized_shard_size", 5000)))
    out["batch_size"] = max(1, int(out.get("batch_size", 1)))
    out["accumulation"] = max(1, int(out.get("accumulation", 8)))
    h = out.get("max_history_turns")
    out["max_history_turns"] = int(h) if h else None
    return out


def cache_key(inputs: dict) -> str:
    """Key of prepared shards over all inputs that change them, order and similarity settings too."""
    return hashlib.sha256(json.dumps(inputs, sort_keys=True, default=str).encode()).hexdigest()[:24]
