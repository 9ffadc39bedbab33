"""Settings of the motion triage."""

from __future__ import annotations

from dataclasses import dataclass

from webloom.fixed_values import SENSITIVITY_FACTORS


@dataclass(frozen=True)
class MotionConfig:
    # Defaults are fixed values.
    sample_fps: float = 8
    min_area_ratio: float = 0.0008
    high_duration: float = 0.5
    event_gap: float = 0.7
    high_score: float = 0.012
    max_screenshots: int = 8
    sensitivity: str = "high"
    min_event_samples: int = 2
    max_event_gap: float = 0.35

    def __post_init__(self) -> None:
        if self.sample_fps <= 0 or self.max_screenshots < 1:
            raise ValueError("sample_fps and max_screenshots must be positive")
        if self.sensitivity not in SENSITIVITY_FACTORS:
            raise ValueError(f"unknown sensitivity: {self.sensitivity}")

    @property
    def factor(self) -> float:
        return SENSITIVITY_FACTORS[self.sensitivity]
