"""Configurations, run manifests, fingerprints and the gates between phases."""

from __future__ import annotations

import copy
import hashlib
import json
import os
import platform
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

PHASES = ("preflight", "smoke", "train", "eval")


class GateError(RuntimeError):
    """A run that must not go on; `check` names the gate."""

    def __init__(self, check: str, message: str):
        super().__init__(message)
        self.check = check


def set_path(config: dict, dotted: str, value: Any) -> None:
    *folders, last = dotted.split(".")
    for f in folders:
        config = config.setdefault(f, {})
    config[last] = value


def get_path(config: dict, dotted: str, default: Any = None) -> Any:
    for f in dotted.split("."):
        if not isinstance(config, dict) or f not in config:
            return default
        config = config[f]
    return config


def flatten(config: dict, prefix: str = "") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for key, value in config.items():
        out |= flatten(value, f"{prefix}{key}.") if isinstance(value, dict) else {f"{prefix}{key}": value}
    return out


def parse_override(text: str) -> tuple[str, Any]:
    """KEY=VALUE with VALUE as JSON, or as text if it is none."""
    key, equals, value = text.partition("=")
    if not equals or not key:
        raise ValueError(f"{text!r} is not KEY=VALUE")
    try:
        return key, json.loads(value)
    except ValueError:
        return key, value


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def resolve(config: dict, overrides: list[str] = (), defaults: dict[str, Any] | None = None, required: list[str] = (), required_if: dict[tuple[str, Any], list[str]] | None = None) -> tuple[dict, str]:
    """The configuration with overrides over defaults, and its hash; keys that must be there are asked for.

    required_if: (key, value) -> keys that a configuration with this value needs."""
    out = copy.deepcopy(config)
    for key, value in (defaults or {}).items():
        if get_path(out, key) is None:
            set_path(out, key, value)
    for text in overrides:
        set_path(out, *parse_override(text))
    wanted = list(required) + [k for (key, value), keys in (required_if or {}).items() if get_path(out, key) == value for k in keys]
    if missing := [k for k in wanted if get_path(out, k) is None]:
        raise GateError("config", f"missing keys: {missing}")
    return out, config_hash(out)


def fingerprint(packages: list[str] = ("pyspark", "pyarrow", "numpy", "pandas"), files: list[str] = ()) -> dict[str, Any]:
    """Versions of what runs, and hashes of files that matter."""
    from importlib.metadata import PackageNotFoundError, version

    def known(p: str) -> str | None:
        try:
            return version(p)
        except PackageNotFoundError:
            return None

    return {"python": platform.python_version(), "system": platform.system(), "packages": {p: known(p) for p in packages}, "files": {f: hashlib.sha256(Path(f).read_bytes()).hexdigest() for f in files}}


def differences(a: dict, b: dict, ignore: tuple[str, ...] = ()) -> dict[str, tuple[Any, Any]]:
    x, y = flatten(a), flatten(b)
    return {k: (x.get(k), y.get(k)) for k in sorted(x.keys() | y.keys()) if x.get(k) != y.get(k) and k not in ignore}


def assert_same(a: dict, b: dict, ignore: tuple[str, ...] = ()) -> None:
    if found := differences(a, b, ignore):
        raise GateError("fingerprint", f"differences: {found}")


def run_manifest(phase: str, config: dict, **details: Any) -> dict:
    if phase not in PHASES:
        raise GateError("phase", f"no phase {phase}")
    return {"phase": phase, "config_hash": config_hash(config), "fingerprint": fingerprint(), "created": datetime.now(UTC).isoformat(), **details}


def save_manifest(manifest: dict, folder: str) -> str:
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{manifest['phase']}-{manifest['created'].replace(':', '')}.json"
    Path(path).write_text(json.dumps(manifest, sort_keys=True, indent=1, ensure_ascii=False))
    return path


def load_manifest(path: str, phase: str | None = None) -> dict:
    manifest = json.loads(Path(path).read_text())
    if phase is not None and manifest["phase"] != phase:
        raise GateError("phase", f"{path} is of {manifest['phase']}, not {phase}")
    return manifest


def latest_manifest(folder: str, phase: str) -> dict | None:
    found = [m for p in Path(folder).glob(f"{phase}-*.json") if (m := load_manifest(str(p)))["phase"] == phase] if os.path.isdir(folder) else []
    return max(found, key=lambda m: m["created"], default=None)


def require_preflight(folder: str, config: dict) -> dict:
    """The newest preflight of this very configuration; without one nothing may be trained."""
    found = latest_manifest(folder, "preflight")
    if found is None or found["config_hash"] != config_hash(config):
        raise GateError("preflight", "no preflight of this configuration")
    return found


def latest_checkpoint(folder: str) -> str | None:
    """The checkpoint-N folder with the largest number."""
    steps = [(int(p.name.rpartition("-")[2]), str(p)) for p in Path(folder).glob("checkpoint-*") if p.name.rpartition("-")[2].isdigit()]
    return max(steps, default=(0, None))[1]
