"""Spectrogram pictures: the cells as a table, and PNG bytes on the driver."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.functions import VIRIDIS, heat_colour
from tessitura.operators.spectrum import log_scaled

CELL_W, CELL_H, MAX_BIN = 5, 4, 140


def cells(spectrum: DataFrame) -> DataFrame:
    """signal_id, frame, bin, level, r, g, b."""
    return log_scaled(spectrum, MAX_BIN).withColumn("c", heat_colour(F.col("level"))).select("signal_id", "frame", "bin", "level", "c.r", "c.g", "c.b")


def colours(level: np.ndarray) -> np.ndarray:
    x = np.clip(level, 0, 1) * (len(VIRIDIS) - 1)
    i = np.minimum(x.astype(int), len(VIRIDIS) - 2)
    table = np.array(VIRIDIS, float)
    return np.floor(table[i] + (table[i + 1] - table[i]) * (x - i)[..., None]).astype(np.uint8)


def picture(mags: np.ndarray, peaks: np.ndarray | None = None) -> np.ndarray:
    """height x width x 3 picture of one recording, low bins at the bottom, with its peaks marked."""
    raw = np.log1p(mags[:, :MAX_BIN] * 200)
    image = colours(raw / (raw.max() or 1)).transpose(1, 0, 2)[::-1].repeat(CELL_H, axis=0).repeat(CELL_W, axis=1)
    for frame, b in peaks if peaks is not None else ():
        if b < MAX_BIN:
            y = image.shape[0] - int(b) * CELL_H - CELL_H // 2
            x = int(frame) * CELL_W + CELL_W // 2
            image[max(y - 2, 0) : y + 2, max(x - 2, 0) : x + 2] = 255
    return image


def png(image: np.ndarray) -> bytes:
    h, w, _ = image.shape
    rows = b"".join(b"\0" + image[i].tobytes() for i in range(h))
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")
