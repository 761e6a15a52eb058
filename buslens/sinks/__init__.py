"""Sinks: the registry, the built-in formats and the fan-out."""

from buslens.sinks import files as _built_in  # noqa: F401  (registers the formats)
from buslens.sinks.fanout import SinkErrors, fan_out
from buslens.sinks.registry import FrameSink, SinkRegistry, sinks

__all__ = ["FrameSink", "SinkErrors", "SinkRegistry", "fan_out", "sinks"]
