"""Analysis parameters, checked when they are made."""

from __future__ import annotations

from dataclasses import asdict, dataclass

WINDOWS = ("", "hann", "hamming", "bartlett")
#: names that may be used; ``algorithms.register`` adds to them
ALGORITHMS = ["constellation", "subband"]

# Fixed values of the fingerprints.
BIN_BITS, DELTA_BITS = 10, 12
PEAK_FRAMES, PEAK_BINS, PEAK_FLOOR = 5, 12, 0.0
FAN_OUT, MIN_GAP, MAX_GAP, MAX_BIN_GAP = 5, 2, 60, 64
POSTING_CAP = 10_000
BANDS, LSH_BITS, LSH_STRIDE, LSH_MAX_FRAME, VERIFY_RADIUS = 40, 12, 2, 65_535, 8
# Bit positions that each of the eight sub-band hash functions reads.
LSH_POSITIONS = (
    (17, 9, 15, 23, 14, 18, 38, 35, 2, 28, 32, 33),
    (29, 27, 20, 2, 24, 32, 11, 13, 26, 33, 25, 18),
    (2, 3, 1, 34, 33, 6, 17, 16, 24, 10, 31, 9),
    (17, 35, 36, 21, 28, 0, 32, 7, 1, 18, 14, 11),
    (18, 30, 5, 4, 27, 15, 26, 6, 14, 29, 17, 0),
    (5, 22, 24, 28, 26, 6, 37, 33, 10, 36, 4, 3),
    (37, 25, 27, 28, 7, 10, 18, 22, 32, 36, 5, 38),
    (35, 3, 31, 36, 10, 32, 0, 22, 34, 16, 20, 27),
)


@dataclass(frozen=True)
class Params:
    win_size: int = 1024
    hop_size: int = 512
    window_func: str = "hann"
    algo: str = "constellation"
    peak_frames: int = PEAK_FRAMES
    peak_bins: int = PEAK_BINS
    peak_floor: float = PEAK_FLOOR

    def __post_init__(self):
        if self.win_size < 2 or self.win_size & (self.win_size - 1):
            raise ValueError(f"win_size must be a power of two of at least 2, not {self.win_size}")
        if self.hop_size < 1:
            raise ValueError(f"hop_size must be positive, not {self.hop_size}")
        if self.window_func not in WINDOWS:
            raise ValueError(f"unknown window function {self.window_func!r}; known: {', '.join(WINDOWS[1:])}")
        if self.algo not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {self.algo!r}; known: {', '.join(ALGORITHMS)}")

    def row(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k in ("win_size", "hop_size", "window_func", "algo")}
