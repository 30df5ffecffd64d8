"""Operator defaults. Passed explicitly; there is no global settings object."""

from __future__ import annotations

from dataclasses import dataclass

# Class ids, class labels and violation codes of the detector.
HELMET, NO_HELMET, MOTORCYCLE = 0, 1, 2
RIDER_CLASSES = (HELMET, NO_HELMET)
CLASS_NAMES = {0: "DRIVER_HELMET", 1: "DRIVER_NO_HELMET", 2: "MOTORCYCLE"}
VIOLATION_TYPES = {0: "no_helmet", 1: "no_helmet"}
DEFAULT_VIOLATION_TYPE = "no_helmet"

DETECTOR_CONFIDENCE = 0.25
TRACKER_ACTIVATION = 0.4
TRACKER_LOST_BUFFER = 120
DISPLAY_IOA = 0.3
MATCH_IOU = 0.5


@dataclass(frozen=True)
class Confirmation:
    """N-frame rule. A zero argument means "use the default"."""

    frames: int = 3
    patience: int = 2
    ioa: float = 0.2
    trigger_class: int = NO_HELMET

    def __post_init__(self):
        for name, default in (("frames", 3), ("patience", 2)):
            if not getattr(self, name):
                object.__setattr__(self, name, default)


def max_time_lost(fps: int = 30, lost_buffer: int = TRACKER_LOST_BUFFER) -> int:
    """Frames a lost track stays alive."""
    return int(fps / 30.0 * lost_buffer)


def effective_fps(fps: int, stride: int) -> int:
    """Frame rate after keeping every ``stride``-th frame."""
    return max(1, fps // stride)
