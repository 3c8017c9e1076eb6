"""Endpoints by role and settings: defaults, environment, an overlay; keys are masked where they are shown."""

from __future__ import annotations

import copy
import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, replace

ROLES = ("default", "extraction", "segment", "review", "compilation", "embedding")
PREFIX = "GRAPNEL"
FIELDS = ("provider", "model", "base_url", "api_key")


@dataclass(frozen=True)
class Endpoint:
    """Where a role's calls go."""

    provider: str = "stand_in"
    model: str = ""
    base_url: str = ""
    api_key: str = ""

    def public(self) -> dict:
        """What may be shown: never the key."""
        return {"provider": self.provider, "model": self.model, "base_url": self.base_url, "api_key": "", "api_key_set": bool(self.api_key), "api_key_masked": masked(self.api_key)}


def masked(key: str) -> str:
    return "" if not key else "*" * len(key) if len(key) < 12 else f"{key[:3]}…{key[-4:]}"


def endpoint(role: str, env: Mapping[str, str] | None = None) -> Endpoint:
    """A role's own variables (``GRAPNEL_<ROLE>_MODEL``), else those of all roles (``GRAPNEL_MODEL``), else defaults."""
    if role not in ROLES:
        raise ValueError(f"role is one of {', '.join(ROLES)}")
    env = os.environ if env is None else env
    found = {f: env.get(f"{PREFIX}_{role.upper()}_{f.upper()}") or env.get(f"{PREFIX}_{f.upper()}") or "" for f in FIELDS}
    return replace(Endpoint(), **{f: v.strip() for f, v in found.items() if v.strip()})


def endpoints(env: Mapping[str, str] | None = None) -> dict[str, Endpoint]:
    return {role: endpoint(role, env) for role in ROLES}


def merged(base: dict, overlay: dict) -> dict:
    """``base`` with ``overlay`` put over it, dictionaries inside dictionaries alike; neither is changed."""
    out = copy.deepcopy(base)
    for key, value in overlay.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def save(path: str, settings: dict, updates: dict) -> dict:
    """The settings with updates, written as JSON in one step: an interrupted write leaves the old file."""
    done = merged(settings, updates)
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump(done, f, ensure_ascii=False, indent=2)
    os.replace(f"{path}.new", path)
    return done


def load(path: str, defaults: dict) -> dict:
    """Defaults with what was saved over them; a missing or broken file changes nothing."""
    try:
        with open(path, encoding="utf-8") as f:
            overlay = json.load(f)
    except (OSError, ValueError):
        return copy.deepcopy(defaults)
    return merged(defaults, overlay) if isinstance(overlay, dict) else copy.deepcopy(defaults)


def segmenter(choice: str, segment: Endpoint) -> str:
    """rule, model, or auto: a model if one can be reached."""
    if choice not in ("rule", "model", "auto"):
        raise ValueError("segmenter is rule, model or auto")
    return choice if choice != "auto" else "model" if segment.api_key else "rule"
