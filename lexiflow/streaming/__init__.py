"""Event operators on Structured Streaming: keyed state in the order of event time, across micro-batches, and timers."""

from .gaze import cooldown_stream, dwell_stream, funnel_stream
from .slots import slot_stream

__all__ = ["cooldown_stream", "dwell_stream", "funnel_stream", "slot_stream"]
