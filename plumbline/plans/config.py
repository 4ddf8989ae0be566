"""Configuration of an audit: defaults, thresholds by dimension, and loading with precedence file < environment < caller."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import asdict, dataclass, field, fields, replace

ENV_PREFIX = "PLUMBLINE_"

#: Fixed values: (warn, fail, direction) of each metric.
BASE_THRESHOLDS = {
    "canary_recall": (0.85, 0.70, "lower_is_worse"),
    "hub_share_top1pct": (0.20, 0.35, "higher_is_worse"),
    "antihub_fraction": (0.25, 0.40, "higher_is_worse"),
    "dfi": (0.15, 0.30, "higher_is_worse"),
    "partition_size_cv": (1.20, 2.00, "higher_is_worse"),
}
#: Largest dimension of a profile and its (warn, fail) of each metric.
PROFILES = {
    "low": (64, {"canary_recall": (0.85, 0.70), "hub_share_top1pct": (0.20, 0.35), "antihub_fraction": (0.25, 0.40), "dfi": (0.15, 0.30), "partition_size_cv": (1.20, 2.00)}),
    "medium": (384, {"canary_recall": (0.85, 0.70), "hub_share_top1pct": (0.28, 0.42), "antihub_fraction": (0.39, 0.50), "dfi": (0.15, 0.30), "partition_size_cv": (1.20, 2.00)}),
    "high": (1024, {"canary_recall": (0.85, 0.70), "hub_share_top1pct": (0.32, 0.45), "antihub_fraction": (0.43, 0.55), "dfi": (0.15, 0.30), "partition_size_cv": (1.30, 2.10)}),
    "ultra_high": (None, {"canary_recall": (0.85, 0.70), "hub_share_top1pct": (0.35, 0.48), "antihub_fraction": (0.46, 0.58), "dfi": (0.15, 0.30), "partition_size_cv": (1.50, 2.25)}),
}
METRICS = tuple(BASE_THRESHOLDS)


class ConfigError(ValueError):
    """An unknown key or a value out of range."""


def profile_for(dimension: int) -> str:
    return next(name for name, (top, _) in PROFILES.items() if top is None or dimension <= top)


@dataclass(frozen=True)
class AuditConfig:
    seed: int = 1337
    queries: int = 200
    k: int = 10
    hubness_sample_size: int = 20_000
    k_hub: int = 10
    hubness_source: str = "truth"
    max_seconds: float | None = None
    max_memory_mb: int | None = None
    block_working_set_mb: int = 256
    strict_unavailable: bool = False
    group_by: str | None = None
    groups_path: str | None = None
    filter_field: str | None = None
    filter_value: str | None = None
    gate_mode: str = "both"
    metrics_enabled: tuple[str, ...] = METRICS
    thresholds: dict = field(default_factory=lambda: dict(BASE_THRESHOLDS))

    def __post_init__(self) -> None:
        if self.queries < 1 or self.k < 1 or self.k_hub < 1 or self.hubness_sample_size < 1:
            raise ConfigError("queries, k, k_hub and the hubness sample must be positive")
        if self.gate_mode not in ("absolute", "delta", "both") or self.hubness_source not in ("truth", "engine"):
            raise ConfigError("unknown gate mode or hubness source")
        if bad := set(self.metrics_enabled) - set(METRICS):
            raise ConfigError(f"unknown metrics: {sorted(bad)}")
        if bad := set(self.thresholds) - set(METRICS):
            raise ConfigError(f"unknown metrics: {sorted(bad)}")
        for m, (warn, fail, direction) in self.thresholds.items():
            if (fail < warn) != (direction == "lower_is_worse") and fail != warn:
                raise ConfigError(f"thresholds of {m} are inverted")

    def for_dimension(self, dimension: int) -> dict:
        """Thresholds of a dimension: the profile's, except where the caller changed the base."""
        changed = PROFILES[profile_for(dimension)][1]
        return {m: (*changed[m], t[2]) if t == BASE_THRESHOLDS[m] else t for m, t in self.thresholds.items()}

    def to_dict(self) -> dict:
        return asdict(self)


def select_metrics(only: list[str] | None = None, skip: list[str] | None = None) -> tuple[str, ...]:
    """The enabled metrics from one of two exclusive lists."""
    if only and skip:
        raise ConfigError("only and skip exclude each other")
    if bad := {*(only or []), *(skip or [])} - set(METRICS):
        raise ConfigError(f"unknown metrics: {sorted(bad)}")
    return tuple(m for m in METRICS if (m in only if only else m not in (skip or [])))


def load_config(path: str | None = None, environ: dict[str, str] | None = None, overrides: dict | None = None) -> AuditConfig:
    """Defaults, then a TOML file (table ``plumbline`` or ``tool.plumbline``), then environment variables, then overrides."""
    names = {f.name: f.type for f in fields(AuditConfig)}
    merged: dict = {}
    if path:
        with open(path, "rb") as f:
            doc = tomllib.load(f)
        merged |= doc.get("plumbline") or doc.get("tool", {}).get("plumbline", {})
    env = os.environ if environ is None else environ
    for key, raw in env.items():
        if key.startswith(ENV_PREFIX):
            name = key[len(ENV_PREFIX) :].lower()
            try:
                merged[name] = json.loads(raw)
            except ValueError:
                merged[name] = raw
    merged |= {k: v for k, v in (overrides or {}).items() if v is not None}
    if bad := set(merged) - set(names):
        raise ConfigError(f"unknown keys: {sorted(bad)}")
    if "thresholds" in merged:
        merged["thresholds"] = dict(BASE_THRESHOLDS) | {m: tuple(t) if len(t) == 3 else (*t, BASE_THRESHOLDS[m][2]) for m, t in merged["thresholds"].items() if m in BASE_THRESHOLDS} | {m: tuple(t) for m, t in merged["thresholds"].items() if m not in BASE_THRESHOLDS}
    if "metrics_enabled" in merged:
        merged["metrics_enabled"] = tuple(merged["metrics_enabled"])
    return replace(AuditConfig(), **merged)
