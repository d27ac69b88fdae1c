"""Column expressions: window coefficients, packed hashes, metric text, colours."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessitura.params import BANDS, BIN_BITS, DELTA_BITS, LSH_BITS, LSH_POSITIONS


def window_coefficient(name: str, i: Column, n: int) -> Column:
    """Symmetric window of length n at place i; no name: 1."""
    angle = F.lit(2 * math.pi) * i / F.lit(n - 1)
    if name == "hann":
        return F.lit(0.5) * (F.lit(1.0) - F.cos(angle))
    if name == "hamming":
        return F.lit(0.54) - F.lit(0.46) * F.cos(angle)
    if name == "bartlett":
        return F.lit(1.0) - F.abs(F.lit(2.0) * i / F.lit(n - 1) - F.lit(1.0))
    if name:
        raise ValueError(f"unknown window function {name!r}")
    return F.lit(1.0)


def pair_hash(f1: Column, f2: Column, dt: Column) -> Column:
    """Two bins and their frame distance in one long."""
    low, far = (1 << BIN_BITS) - 1, (1 << DELTA_BITS) - 1
    a, b, d = (x.cast("long") for x in (f1, f2, dt))
    return a.bitwiseAND(low).bitwiseOR(F.shiftleft(b.bitwiseAND(low), BIN_BITS)).bitwiseOR(F.shiftleft(d.bitwiseAND(far), 2 * BIN_BITS))


def falling_bits(energies: Column) -> Column:
    """array<int> of 39 bits: is a band stronger than the next?"""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 2)), lambda i: F.when(F.get(energies, i) > F.get(energies, i + 1), 1).otherwise(0))


def packed(bits: Column) -> Column:
    """Bits as one long, the first lowest."""
    return F.aggregate(F.transform(bits, lambda b, i: F.call_function("shiftleft", b.cast("long"), i)), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def lsh_keys(bits: Column) -> Column:
    """array<int> of the eight keys of a packed frame: function number and twelve sampled bits."""
    def key(n: int, positions) -> Column:
        out = F.lit(n << LSH_BITS).cast("long")
        for place, position in enumerate(positions):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(bits, position).bitwiseAND(1), place))
        return out.cast("int")

    return F.array(*(key(n, p) for n, p in enumerate(LSH_POSITIONS)))


def metric_number(v: Column) -> Column:
    """Six decimals without trailing zeros; infinities and NaN by name."""
    text = F.regexp_replace(F.format_string("%.6f", v), r"\.?0+$", "")
    return F.when(F.isnan(v), "NaN").when(v == float("inf"), "+Inf").when(v == float("-inf"), "-Inf").otherwise(text)


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


# Control colours of the heat map, dark to bright.
VIRIDIS = ((68, 1, 84), (72, 35, 116), (64, 67, 135), (52, 94, 141), (33, 144, 140), (53, 183, 121), (143, 215, 68), (253, 231, 37))


def heat_colour(v: Column) -> Column:
    """struct<r, g, b> for a value in [0, 1], interpolated between the control colours and cut to whole numbers."""
    x = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * F.lit(float(len(VIRIDIS) - 1))
    i = F.least(F.floor(x).cast("int"), F.lit(len(VIRIDIS) - 2))
    channel = lambda c: F.array(*(F.lit(float(p[c])) for p in VIRIDIS))
    mixed = lambda c: F.floor(F.get(channel(c), i) + (F.get(channel(c), i + 1) - F.get(channel(c), i)) * (x - i)).cast("int")
    return F.struct(mixed(0).alias("r"), mixed(1).alias("g"), mixed(2).alias("b"))
