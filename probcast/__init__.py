"""Probability-forecast resolution, scoring and sampling on Spark DataFrames."""

from probcast.session import build_session

__all__ = ["build_session"]
__version__ = "0.1.0"
