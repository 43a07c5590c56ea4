"""Settings of the analytics operators."""

from __future__ import annotations

from dataclasses import dataclass

# Image and bin sizes, weights and thresholds that results depend on.
IMAGE_WIDTH, IMAGE_HEIGHT = 640, 360
SCALE = 3
EPS = 1e-6
SIZE_WEIGHT, SHARPNESS_WEIGHT = 0.48, 0.52
REDUNDANCY_WEIGHT = 0.5
FILL_RATIO = 0.95
TAIL_FRAMES = 1500


@dataclass(frozen=True)
class BinSize:
    """The size of an enhancement bin."""

    width: int = 256
    height: int = 256

    def __post_init__(self) -> None:
        if self.width <= 0 or self.height <= 0:
            raise ValueError(f"a bin's sides must be positive: {self.width} x {self.height}")

    @property
    def area(self) -> int:
        return self.width * self.height


@dataclass(frozen=True)
class ProposalSettings:
    """Background subtraction, box filters, consolidation and splitting."""

    background: str = "mixture"  # or "average"
    variance_threshold: float = 60.0
    shadows: bool = True
    warmup_frames: int = 300
    learning_rate: float = 0.001
    warmup_learning_rate: float = 0.01
    difference: int = 25
    min_area: int = 200
    min_aspect: float = 0.2
    max_aspect: float = 5.0
    close_size: int = 7
    open_size: int = 3
    merge_iou: float = 0.1
    merge_gap_x: int = 12
    merge_overlap: float = 0.7
    merge_bottom: int = 12
    split_by_q90: bool = False
    split_gamma_width: float = 1.6
    split_gamma_height: float = 1.8
    split_gamma_area: float = 2.0
    split_ratio: float = 1.8
    split_size: int = 100
    split_sigma: float = 1.5
    split_peak_distance: float = 0.25
    split_peak_height: float = 0.5
    split_valley: float = 0.6
