"""Configuration: overrides merged over defaults, and a fingerprint of the result (S-09, F-26)."""

from __future__ import annotations

import hashlib
import json
import tomllib
from pathlib import Path

DEFAULTS: dict = {
    "scan": {"includeHidden": False, "maxFileSizeBytes": 10_485_760},
    "limits": {"maxFiles": 100_000, "maxTotalBytes": 1_073_741_824},  # of the scan; those of the analysis are in plans.analyze.LIMITS and can be set here too
    "domains": {"minimumTokenLength": 3, "featureHttpMatchWeight": 0.40, "featureCallWeight": 0.15, "featureFlowWeight": 0.15, "featureResourceWeight": 0.10, "featurePathWeight": 0.05, "featureLexicalWeight": 0.15},
    "bundle": {"partTargetBytes": 1_000_000},
}


def merged(base: dict, over: dict) -> dict:
    """Tables merge, all else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(path: str | Path | None = None, defaults: dict = DEFAULTS) -> dict:
    """Defaults with the overrides of a TOML or JSON file."""
    if path is None:
        return merged(defaults, {})
    raw = Path(path).read_bytes()
    return merged(defaults, json.loads(raw) if str(path).endswith(".json") else tomllib.loads(raw.decode()))


def fingerprint(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
