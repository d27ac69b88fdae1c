"""Sub-band bits: mel energies to 39 bits a frame, an LSH index, votes, Hamming verification."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions import falling_bits, lsh_keys, packed
from tessitura.operators.constellation import best_delta, capped
from tessitura.params import BANDS, LSH_MAX_FRAME, LSH_STRIDE, POSTING_CAP, VERIFY_RADIUS


def mel_edges(win_size: int, sample_rate: int, bands: int = BANDS) -> list[int]:
    """bands + 2 bin numbers, evenly spaced in mel, halves rounded away from zero, inside the spectrum."""
    top = 2595 * math.log10(1 + sample_rate / 2 / 700)
    hertz = (700 * (10 ** (top * i / (bands + 1) / 2595) - 1) for i in range(bands + 2))
    return [min(math.floor(f * win_size / sample_rate + 0.5), win_size // 2) for f in hertz]


def mel_energies(spectrum: DataFrame, win_size: int, sample_rate: int) -> DataFrame:
    """signal_id, frame, energies array<double>: mean squared magnitude of each [edge, next edge), at least one bin."""
    edges = mel_edges(win_size, sample_rate)
    bands = []
    for low, high in zip(edges[:BANDS], edges[1 : BANDS + 1], strict=True):
        high = max(high, low + 1)
        part = F.slice("mags", low + 1, high - low)
        bands.append(F.aggregate(part, F.lit(0.0), lambda a, m: a + m * m) / F.lit(float(high - low)))
    return spectrum.select("signal_id", "frame", F.array(*bands).alias("energies"))


def subband_frames(energies: DataFrame) -> DataFrame:
    """signal_id, frame, bits long."""
    return energies.select("signal_id", "frame", packed(falling_bits(F.col("energies"))).alias("bits"))


def lsh_index(frames: DataFrame, cap: int = POSTING_CAP) -> DataFrame:
    """lsh_key, song_id, frame of every second frame, without saturated keys."""
    some = frames.where((F.col("frame") % LSH_STRIDE == 0) & (F.col("frame") <= LSH_MAX_FRAME))
    return capped(some.select("song_id", "frame", F.explode(lsh_keys(F.col("bits"))).alias("lsh_key")), "lsh_key", cap).select("lsh_key", "song_id", "frame")


def lsh_votes(samples: DataFrame, index: DataFrame) -> DataFrame:
    """sample_id, song_id, delta, votes: sample frames that agree with a song on a delta by any key."""
    s = samples.select("sample_id", F.col("frame").alias("at"), F.explode(lsh_keys(F.col("bits"))).alias("lsh_key"))
    both = s.join(index, "lsh_key").select("sample_id", "song_id", (F.col("frame") - F.col("at")).alias("delta"), "at").distinct()
    return both.groupBy("sample_id", "song_id", "delta").agg(F.count("*").alias("votes"))


def agreement(mismatches, bits):
    return F.greatest(F.lit(0.0), (F.lit(1.0) - mismatches / bits - F.lit(0.5)) * F.lit(2.0))


def offset_scores(candidates: DataFrame, samples: DataFrame, songs: DataFrame) -> DataFrame:
    """sample_id, song_id, offset, score for candidates (sample_id, song_id, low, high): frames laid side by side."""
    spots = candidates.where("high >= low").select("sample_id", "song_id", F.explode(F.sequence("low", "high")).alias("offset"))
    s = samples.select("sample_id", F.col("frame").alias("at"), F.col("bits").alias("own"))
    laid = spots.join(s, "sample_id").withColumn("frame", F.col("offset") + F.col("at")).join(songs.select("song_id", "frame", "bits"), ["song_id", "frame"])
    wrong = F.sum(F.bit_count(F.col("own").bitwiseXOR(F.col("bits"))))
    out = laid.groupBy("sample_id", "song_id", "offset").agg(wrong.alias("wrong"), F.count("*").alias("n"))
    return out.select("sample_id", "song_id", "offset", agreement(F.col("wrong"), F.col("n") * (BANDS - 1)).alias("score"))


def best_offset(scores: DataFrame) -> DataFrame:
    best = F.max(F.struct("score", (-F.col("offset")).alias("back"))).alias("b")
    return scores.groupBy("sample_id", "song_id").agg(best).select("sample_id", "song_id", F.col("b.score").alias("score"), (-F.col("b.back")).alias("offset"))


def frame_counts(frames: DataFrame, key: str) -> DataFrame:
    return frames.groupBy(key).agg((F.max("frame") + 1).alias("n"))


def match(samples: DataFrame, songs: DataFrame, k: int = 5, cap: int = POSTING_CAP) -> DataFrame:
    """sample_id, rank, song_id, score, votes, offset; candidates by LSH, verified within 8 frames of their delta."""
    k = k if k > 0 else 5
    found = best_delta(lsh_votes(samples, lsh_index(songs, cap)))
    w = Window.partitionBy("sample_id").orderBy(F.desc("votes"), "delta", "song_id")
    found = found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(2 * k, 10)).where("votes >= 2")
    found = found.join(frame_counts(samples, "sample_id").withColumnRenamed("n", "ns"), "sample_id").join(frame_counts(songs, "song_id").withColumnRenamed("n", "nt"), "song_id")
    low, high = F.greatest(F.col("delta") - VERIFY_RADIUS, F.lit(0)), F.least(F.col("delta") + VERIFY_RADIUS, F.col("nt") - F.col("ns"))
    spots = found.select("sample_id", "song_id", "votes", low.cast("int").alias("low"), high.cast("int").alias("high"))
    best = best_offset(offset_scores(spots, samples, songs)).where("score > 0").join(found.select("sample_id", "song_id", "votes"), ["sample_id", "song_id"])
    w = Window.partitionBy("sample_id").orderBy(F.desc("score"), "song_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("sample_id", "rank", "song_id", "score", "votes", "offset")


def full_slide(pairs: DataFrame, samples: DataFrame, songs: DataFrame) -> DataFrame:
    """Best score and offset over every place of the sample in the song, for pairs (sample_id, song_id); -1 if it is longer."""
    sized = pairs.join(frame_counts(samples, "sample_id").withColumnRenamed("n", "ns"), "sample_id").join(frame_counts(songs, "song_id").withColumnRenamed("n", "nt"), "song_id")
    spots = sized.select("sample_id", "song_id", F.lit(0).alias("low"), (F.col("nt") - F.col("ns")).cast("int").alias("high"))
    best = best_offset(offset_scores(spots, samples, songs))
    return pairs.join(best, ["sample_id", "song_id"], "left").select("sample_id", "song_id", F.coalesce("score", F.lit(-1.0)).alias("score"), "offset")


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """a_id, b_id, score of signals (id, frame, bits) laid frame by frame."""
    both = a.select(F.col("id").alias("a_id"), "frame", F.col("bits").alias("x")).join(b.select(F.col("id").alias("b_id"), "frame", F.col("bits").alias("y")), "frame")
    out = both.groupBy("a_id", "b_id").agg(F.sum(F.bit_count(F.col("x").bitwiseXOR(F.col("y")))).alias("wrong"), F.count("*").alias("n"))
    return out.select("a_id", "b_id", agreement(F.col("wrong"), F.col("n") * (BANDS - 1)).alias("score"))
