"""All queries of the engine's own operators."""

from .plans import q_files, q_functions, q_layers, q_more, q_naming, q_rollups, q_routing, q_scores, q_sources, q_tracks, q_workouts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
