"""Reconstruct and forecast a lost sensor station from its neighbours, on Spark."""

from stationweave.specs import ModelSpec, StationSpec, Task

__all__ = ["ModelSpec", "StationSpec", "Task"]
