"""Defaults of the engine; every operator takes the value it needs as a parameter."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Comparison:
    """Thresholds in kilometres for comparing two tracks."""

    centroid_km: float = 5.0
    extent_km: float = 10.0
    length_ratio: float = 1.25
    overlap: float = 0.0
    similar_km: float = 2.0


COMMUTE = Comparison(2.5, 5.0, 1.5, 0.3, 0.5)
LONG_RIDE = Comparison()


@dataclass(frozen=True)
class EngineConfig:
    similarity: float = 0.70
    long_ride_km: float = 1.2
    weights: dict[str, float] = field(default_factory=lambda: {"time": 0.25, "distance": 0.10, "safety": 0.35, "weather": 0.30})
    plus_ratio: float = 1.15
    cluster_eps_deg: float = 0.002
    cluster_min: int = 5
    near_m: float = 500.0
    zoom: int = 14
    snap_m: float = 30.0
    gap_m: float = 80.0
    stale_after_h: float = 2.0
    degraded_until_h: float = 24.0
    max_weather_rows: int = 500
    max_jobs: int = 100


# Names that say nothing about a route; mining group rides knows one more.
GENERIC_NAMES = ("Morning Ride", "Afternoon Ride", "Evening Ride", "Lunch Ride")
GENERIC_GROUP_NAMES = ("Morning Ride", "Afternoon Ride", "Evening Ride", "Lunch Ride", "Night Ride")
