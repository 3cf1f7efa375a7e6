"""The configuration file: datasets, consistency rules and features, as JSON or YAML."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path


class ConfigError(Exception):
    """The configuration can't be read or doesn't fit."""


@dataclass(frozen=True)
class Dataset:
    id: str
    location: str
    format: str = "gtfs"
    license: object = None
    groups: tuple[str, ...] = ()
    headers: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Config:
    datasets: tuple[Dataset, ...]
    consistency: dict[str, dict]  # group -> its rules, radii in metres
    validate: bool = True


def parse_distance(value: object) -> float:
    """Metres from a number or a text like ``42`` or ``42.5m``."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    found = re.fullmatch(r"([0-9]+(?:\.[0-9]*)?)m?", value) if isinstance(value, str) else None
    if not found:
        raise ConfigError(f"no distance: {value!r}")
    return float(found[1])


def _dataset(raw: dict) -> Dataset:
    source = raw.get("src") or {}
    location = source.get("url") or source.get("path")
    if not raw.get("id") or not location:
        raise ConfigError("a dataset needs an id, and under src an url or a path")
    if raw.get("format") not in ("gtfs", "gtfs-rt"):
        raise ConfigError(f"format of {raw['id']}: {raw.get('format')!r}")
    license_ = raw.get("license")
    return Dataset(raw["id"], location, raw["format"], license_.strip() if isinstance(license_, str) else license_, tuple(raw.get("groups") or ()), dict(source.get("headers") or {}))


def _rules(raw: dict) -> dict:
    ids = lambda v: {"tolerance": 0.5} if v is None else v
    radii = raw.get("stop_coordinates") or {"radius": 20}
    return {"stop_ids": ids(raw.get("stop_ids")), "trip_ids": ids(raw.get("trip_ids")), "stop_coordinates": {k: parse_distance(v) for k, v in radii.items()}}


def load_config(path: str) -> Config:
    """Read a ``.json``, ``.yml`` or ``.yaml`` file; the version is 1, as number or text."""
    kind = Path(path).suffix
    if kind not in (".json", ".yml", ".yaml"):
        raise ConfigError(f"unknown kind of configuration: {kind!r}")
    try:
        text = Path(path).read_text()
        if kind == ".json":
            raw = json.loads(text)
        else:
            import yaml

            raw = yaml.safe_load(text)
    except (OSError, ValueError) as e:
        raise ConfigError(str(e)) from e
    if not isinstance(raw, dict) or str(raw.get("version")) != "1" or "datasets" not in raw:
        raise ConfigError("version 1 and datasets are needed")
    groups = {g["id"]: _rules(g.get("consistency") or {}) for g in raw.get("dataset_groups") or ()}
    validation = ((raw.get("features") or {}).get("preprocessing") or {}).get("validation", True)
    return Config(tuple(_dataset(d) for d in raw["datasets"]), groups, validation is not False)
