"""Settings, glossaries and lists of terms to leave alone: small files that the driver reads."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path


def _parsed(path: Path):
    if path.suffix.lower() == ".json":
        return json.loads(path.read_text("utf-8"))
    import yaml

    return yaml.safe_load(path.read_text("utf-8"))


def config(path: str) -> dict:
    """The file's mapping; empty if there is no such file or nothing in it."""
    if not Path(path).exists():
        return {}
    found = _parsed(Path(path))
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def merged(base: dict, over: dict) -> dict:
    """A new mapping in which `over` wins; mappings on both sides are merged in turn."""
    both = {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}
    return base | both


def signature(settings: dict) -> str:
    """SHA-256 of the settings, whatever the order of their keys."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def glossary(path: str) -> dict[str, str]:
    """Term to target, both as text; pairs with a null are left out."""
    if Path(path).suffix.lower() not in (".yaml", ".yml", ".json"):
        raise ValueError(f"{path}: a glossary is YAML or JSON")
    found = _parsed(Path(path)) or {}
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return {str(k): str(v) for k, v in found.items() if k is not None and v is not None}


def terms(path: str) -> list[str]:
    """Distinct trimmed terms in file order: a YAML or JSON list (or its key `terms`), or lines of text with # comments."""
    if Path(path).suffix.lower() in (".yaml", ".yml", ".json"):
        found = _parsed(Path(path)) or []
        found = found.get("terms") or [] if isinstance(found, dict) else found
    else:
        found = [x for x in Path(path).read_text("utf-8").splitlines() if not x.strip().startswith("#")]
    return list(dict.fromkeys(t for x in found if x is not None and (t := str(x).strip())))
