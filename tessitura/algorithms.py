"""Fingerprint algorithms by name: two are built in, others can be registered.

An algorithm turns recordings into prints, matches prints of clips with those of songs,
and says by which column a library sorts its prints.  ``register`` makes it known to
``Params``, libraries, the command line and the server.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura import params
from tessitura.operators import constellation, fingerprint, subband


class Algorithm(Protocol):
    name: str
    key: str

    def fingerprint(self, signals: DataFrame, p: params.Params, sample_rate: int) -> DataFrame:
        """song_id and print columns of recordings (song_id, samples)."""

    def match(self, samples: DataFrame, prints: DataFrame, k: int) -> DataFrame:
        """sample_id, rank, song_id, score, votes, offset of prints keyed by sample_id against prints keyed by song_id."""

    def similarity(self, samples: DataFrame, prints: DataFrame, songs: DataFrame) -> DataFrame:
        """sample_id, song_id, similarity."""


class Constellation:
    name, key = "constellation", "hash"

    def fingerprint(self, signals, p, sample_rate):
        return fingerprint.hashes(signals, p)

    def match(self, samples, prints, k):
        return constellation.match(samples, constellation.capped(prints), k).withColumnRenamed("delta", "offset")

    def similarity(self, samples, prints, songs):
        """Songs with anything in common."""
        return constellation.similarity(samples.withColumn("entry_id", F.struct("offset", "hash")), prints)


class Subband:
    name, key = "subband", "song_id"

    def fingerprint(self, signals, p, sample_rate):
        return fingerprint.frames(signals, p, sample_rate)

    def match(self, samples, prints, k):
        return subband.match(samples, prints, k)

    def similarity(self, samples, prints, songs):
        """Every song: all pairs are the result asked for."""
        pairs = samples.select("sample_id").distinct().crossJoin(songs.select("song_id"))
        return subband.full_slide(pairs, samples, prints).select("sample_id", "song_id", F.col("score").alias("similarity"))


_KNOWN: dict[str, Algorithm] = {}


def register(new: Algorithm) -> None:
    """Make an algorithm known by its name; a name can be taken once."""
    if new.name in _KNOWN:
        raise ValueError(f"algorithm {new.name!r} is registered already")
    _KNOWN[new.name] = new
    if new.name not in params.ALGORITHMS:
        params.ALGORITHMS.append(new.name)


def algorithm(name: str) -> Algorithm:
    if name not in _KNOWN:
        raise ValueError(f"unknown algorithm {name!r}; known: {', '.join(_KNOWN)}")
    return _KNOWN[name]


register(Constellation())
register(Subband())
