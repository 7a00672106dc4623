"""Time-indexed media data on Spark: frames, samples, tracks and cues as DataFrames."""

from .clips import Clip, apply_all
from .errors import EngineError
from .mediatime import MediaTime

__all__ = ["Clip", "EngineError", "MediaTime", "apply_all"]
