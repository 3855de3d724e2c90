"""Weights and thresholds of scoring and resolution; every operator takes them as a parameter."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Weights:
    sku: float = 0.40
    model: float = 0.20
    colorway: float = 0.15
    embedding: float = 0.15
    metadata: float = 0.05
    agreement: float = 0.05


@dataclass(frozen=True)
class Thresholds:
    high: float = 0.95
    medium: float = 0.85
    low: float = 0.70
    similarity_floor: float = 0.70
    similarity_full: float = 0.92
    runner_up_gap: float = 0.05


@dataclass(frozen=True)
class Settings:
    weights: Weights = field(default_factory=Weights)
    thresholds: Thresholds = field(default_factory=Thresholds)
    resolution_ttl_days: int = 7
    requests_per_minute: int = 60
