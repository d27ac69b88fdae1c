"""Signal generators with fixed seeds."""

import numpy as np

RATE = 44100


def times(seconds):
    return np.arange(int(seconds * RATE)) / RATE


def tone(freq, seconds):
    return 0.8 * np.sin(2 * np.pi * freq * times(seconds))


def rich(fundamental, seconds):
    """Seven harmonics of falling strength whose pitch drifts up by a hundredth."""
    t = times(seconds)
    drift = t * (1 + 0.005 * t / max(seconds, 1e-9))
    return sum(0.6 * 0.55**m * np.sin(2 * np.pi * fundamental * (m + 1) * drift + m) for m in range(7))


def tune(seed, seconds):
    """Short notes drawn by a seed: distinct, with peaks all along."""
    r = np.random.default_rng(seed)
    parts = []
    while sum(map(len, parts)) < seconds * RATE:
        parts.append(rich(r.uniform(110, 1200), 0.1) * r.uniform(0.3, 1) + 0.02 * r.standard_normal(int(0.1 * RATE)))
    return np.clip(np.concatenate(parts)[: int(seconds * RATE)], -1, 1)
