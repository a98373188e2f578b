"""Imports every module that registers queries."""

from lumenframe.plans import q_colour, q_frames, q_functions, q_series, q_space, q_spectral, q_timeline
from lumenframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "q_colour", "q_frames", "q_functions", "q_series", "q_space", "q_spectral", "q_timeline"]
