"""Signals to spectra.

``signals``: (signal_id, pos, sample), one row a sample.  Frame f starts at f * hop;
there are (length - win) div hop frames, so the last full one is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions import window_coefficient
from tessitura.params import Params


def normalized(signals: DataFrame) -> DataFrame:
    """Samples over the signal's largest magnitude; silent signals stay."""
    peak = signals.groupBy("signal_id").agg(F.max(F.abs("sample")).alias("peak"))
    out = signals.join(peak, "signal_id")
    return out.select("signal_id", "pos", F.when(F.col("peak") > 0, F.col("sample") / F.col("peak")).otherwise(F.col("sample")).alias("sample"))


def with_noise(signals: DataFrame, scale: float, seed: int) -> DataFrame:
    """Uniform noise of ``scale`` times the peak; the same for a seed, however the rows are dealt."""
    if scale <= 0:
        return signals
    unit = F.pmod(F.xxhash64(F.lit(seed), "signal_id", "pos"), F.lit(1 << 30)) / F.lit(float(1 << 29)) - 1
    peak = signals.groupBy("signal_id").agg(F.max(F.abs("sample")).alias("peak"))
    return signals.join(peak, "signal_id").select("signal_id", "pos", (F.col("sample") + unit * F.col("peak") * scale).alias("sample"))


def lengths(signals: DataFrame, params: Params) -> DataFrame:
    """signal_id, n_samples, n_frames."""
    out = signals.groupBy("signal_id").agg((F.max("pos") + 1).alias("n_samples"))
    frames = F.greatest(F.floor((F.col("n_samples") - params.win_size) / params.hop_size), F.lit(0))
    return out.withColumn("n_frames", frames.cast("int"))


def framed(signals: DataFrame, params: Params) -> DataFrame:
    """signal_id, frame, i, sample: each sample once for every frame it lies in; no join on positions."""
    win, hop = params.win_size, params.hop_size
    low = F.greatest(F.ceil((F.col("pos") - win + 1) / hop), F.lit(0)).cast("int")
    high = F.least(F.floor(F.col("pos") / hop), F.col("n_frames") - 1).cast("int")
    out = signals.join(lengths(signals, params), "signal_id").where(high >= low)
    out = out.select("signal_id", "pos", "sample", F.explode(F.sequence(low, high)).alias("frame"))
    return out.select("signal_id", "frame", (F.col("pos") - F.col("frame") * hop).cast("int").alias("i"), "sample")


def magnitudes(frames: np.ndarray, window: np.ndarray) -> np.ndarray:
    """frames x win samples to frames x (win / 2 + 1) magnitudes."""
    return np.abs(np.fft.rfft(frames * window, axis=1)) * (2 / frames.shape[1])


def coefficients(name: str, n: int) -> np.ndarray:
    i = np.arange(n)
    if name == "hann":
        return 0.5 * (1 - np.cos(2 * np.pi * i / (n - 1)))
    if name == "hamming":
        return 0.54 - 0.46 * np.cos(2 * np.pi * i / (n - 1))
    if name == "bartlett":
        return 1 - np.abs(2 * i / (n - 1) - 1)
    return np.ones(n)


def spectrogram(signals: DataFrame, params: Params) -> DataFrame:
    """signal_id, frame, mags array<double>: parallel over frames, not signals."""
    win = params.win_size
    packed = framed(normalized(signals), params).groupBy("signal_id", "frame").agg(F.sort_array(F.collect_list(F.struct("i", "sample"))).alias("x"))
    packed = packed.select("signal_id", "frame", F.col("x.sample").alias("x"))
    kind = signals.schema["signal_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        window = coefficients(params.window_func, win)
        for b in batches:
            if len(b):
                yield pd.DataFrame({"signal_id": b["signal_id"], "frame": b["frame"], "mags": list(magnitudes(np.stack(b["x"].to_numpy()), window))})

    return packed.mapInPandas(run, f"signal_id {kind}, frame int, mags array<double>")


def long_form(spectrum: DataFrame) -> DataFrame:
    """signal_id, frame, bin, mag."""
    return spectrum.select("signal_id", "frame", F.posexplode("mags").alias("bin", "mag"))


def log_scaled(spectrum: DataFrame, bins: int = 140) -> DataFrame:
    """signal_id, frame, bin, level: log1p(200 * mag) of the lowest bins over the signal's largest level."""
    out = long_form(spectrum).where(F.col("bin") < bins).withColumn("raw", F.log1p(F.col("mag") * 200))
    top = out.groupBy("signal_id").agg(F.max("raw").alias("top"))
    return out.join(top, "signal_id").select("signal_id", "frame", "bin", "raw", (F.col("raw") / F.when(F.col("top") > 0, F.col("top")).otherwise(1.0)).alias("level"))


def windows_table(spark, name: str, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("i"), window_coefficient(name, F.col("id"), n).alias("w"))


def peaks(cells: DataFrame, frames: int, bins: int, floor: float = 0.0) -> DataFrame:
    """signal_id, frame, bin of strict maxima over +-frames x +-bins above the floor; a tie spoils both.

    The neighbourhood is separable: the rest of the row, then the rows' maxima along the bin's column.
    """
    row = Window.partitionBy("signal_id", "frame").orderBy("bin")
    column = Window.partitionBy("signal_id", "bin").orderBy("frame")
    most = lambda w, a, b, c: F.max(c).over(w.rangeBetween(a, b))
    out = cells.withColumn("beside", F.greatest(most(row, -bins, -1, "mag"), most(row, 1, bins, "mag")))
    out = out.withColumn("stripe", F.greatest("mag", "beside"))
    out = out.withColumn("around", F.greatest(most(column, -frames, -1, "stripe"), most(column, 1, frames, "stripe")))
    apart = lambda c: F.col(c).isNull() | (F.col("mag") > F.col(c))
    return out.where((F.col("mag") > floor) & apart("beside") & apart("around")).select("signal_id", F.col("frame").cast("int").alias("frame"), F.col("bin").cast("int").alias("bin"))
