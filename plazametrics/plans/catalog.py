"""All registered queries."""

from __future__ import annotations

from . import queries_analysis, queries_frames, queries_scalar, queries_venue
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "queries_analysis", "queries_frames", "queries_scalar", "queries_venue"]
