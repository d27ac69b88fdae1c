"""Recordings to fingerprints in one pass: the production path of both algorithms.

``signals``: (song_id, samples array<double>), one row a recording.  The dense part
(spectrum, peaks or mel bits) is one Arrow stage with no shuffle; pairing and packing
are Spark expressions.  Long recordings are cut into overlapping spans of frames first,
with the margin that peaks need, so a recording's length doesn't set a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.operators import constellation, subband
from tessitura.operators.spectrum import coefficients, magnitudes
from tessitura.params import BANDS, Params

SPAN = 2048


class SignalTooShort(ValueError):
    pass


def n_frames(n_samples: int, params: Params) -> int:
    return max((n_samples - params.win_size) // params.hop_size, 0)


def spectra(samples: np.ndarray, params: Params) -> np.ndarray:
    """All frames of a piece whose first sample is the first frame's."""
    n = n_frames(len(samples), params)
    if n == 0:
        raise SignalTooShort("signal too short")
    frames = sliding_window_view(samples, params.win_size)[:: params.hop_size][:n]
    return magnitudes(frames, coefficients(params.window_func, params.win_size))


def _most(x: np.ndarray, radius: int, axis: int, own: bool) -> np.ndarray:
    """Maximum over +-radius along an axis, with or without the cell itself."""
    pad = [(0, 0)] * x.ndim
    pad[axis] = (radius, radius)
    w = sliding_window_view(np.pad(x, pad, constant_values=-np.inf), 2 * radius + 1, axis=axis)
    if own:
        return w.max(axis=-1)
    return np.maximum(w[..., :radius].max(axis=-1), w[..., radius + 1 :].max(axis=-1))


def find_peaks(mags: np.ndarray, frames: int, bins: int, floor: float = 0.0) -> np.ndarray:
    """(frame, bin) of strict maxima, in that order."""
    beside = _most(mags, bins, 1, own=False)
    around = _most(np.maximum(mags, beside), frames, 0, own=False)
    return np.argwhere((mags > floor) & (mags > beside) & (mags > around))


def spans(signals: DataFrame, params: Params, margin: int) -> DataFrame:
    """song_id, first (frame of the span proper), lead (margin frames before it), count, samples of span and margins."""
    hop, win = params.hop_size, params.win_size
    n = F.greatest(F.floor((F.size("samples") - win) / hop), F.lit(0)).cast("int")
    out = signals.select("song_id", "samples", n.alias("n")).where("n > 0")
    out = out.select("song_id", "samples", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / SPAN).cast("int"))).alias("k"))
    first = F.col("k") * SPAN
    lead = F.least(F.lit(margin), first)
    last = F.least(first + SPAN + margin, F.col("n"))
    piece = F.slice("samples", (first - lead) * hop + 1, (last - first + lead) * hop + win)
    return out.select("song_id", first.alias("first"), lead.alias("lead"), F.least(F.lit(SPAN), F.col("n") - first).alias("count"), piece.alias("samples"))


def peaks(signals: DataFrame, params: Params) -> DataFrame:
    """signal_id, frame, bin.  Strict comparison makes peaks the same at any gain, so no pass for the maximum is needed."""
    margin = params.peak_frames

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for song, first, lead, count, samples in b.itertuples(index=False):
                x = np.asarray(samples, float)
                found = find_peaks(spectra(x, params), params.peak_frames, params.peak_bins, params.peak_floor)
                frame = found[:, 0] + first - lead
                own = (frame >= first) & (frame < first + count)
                yield pd.DataFrame({"signal_id": song, "frame": frame[own].astype(np.int32), "bin": found[own, 1].astype(np.int32)})

    return spans(signals, params, margin).mapInPandas(run, "signal_id long, frame int, bin int")


def hashes(signals: DataFrame, params: Params) -> DataFrame:
    """song_id, hash, offset."""
    return constellation.pair_hashes(peaks(signals, params)).select(F.col("signal_id").alias("song_id"), "hash", "offset")


def frames(signals: DataFrame, params: Params, sample_rate: int = 44100) -> DataFrame:
    """song_id, frame, bits."""
    edges = subband.mel_edges(params.win_size, sample_rate)
    weights = np.int64(1) << np.arange(BANDS - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for song, first, _, count, samples in b.itertuples(index=False):
                power = spectra(np.asarray(samples, float), params)[:count] ** 2
                bands = np.stack([power[:, lo : max(hi, lo + 1)].mean(axis=1) for lo, hi in zip(edges[:BANDS], edges[1:], strict=False)], axis=1)
                bits = (bands[:, :-1] > bands[:, 1:]) @ weights
                yield pd.DataFrame({"song_id": song, "frame": np.arange(first, first + len(bits), dtype=np.int32), "bits": bits})

    return spans(signals, params, 0).mapInPandas(run, "song_id long, frame int, bits long")
