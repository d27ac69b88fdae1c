"""Landmark pairs: peaks to hashes, an inverted index, votes on (song, delta)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions import pair_hash
from tessitura.params import FAN_OUT, MAX_BIN_GAP, MAX_GAP, MIN_GAP, POSTING_CAP

CHUNK = 4096
#: pairs of offsets for each delta beyond which a transform is cheaper
DIRECT = 8


def pair_hashes(peaks: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """signal_id, offset, hash, target_frame, target_bin: each anchor with its next peaks, in order of (frame, bin).

    No self-join: a range window gathers the peaks 2 to 60 frames ahead.  Signals are cut
    into chunks of frames with a margin of 60, so a long one is not one task.
    """
    chunk = F.floor(F.col("frame") / CHUNK).cast("int")
    places = F.when((F.col("frame") % CHUNK <= MAX_GAP) & (chunk > 0), F.array(chunk, chunk - 1)).otherwise(F.array(chunk))
    ahead = Window.partitionBy("signal_id", "chunk").orderBy("frame").rangeBetween(MIN_GAP, MAX_GAP)
    out = peaks.withColumn("own", chunk).withColumn("chunk", F.explode(places))
    out = out.withColumn("ahead", F.collect_list(F.struct("frame", "bin")).over(ahead)).where("own = chunk")
    near = F.filter("ahead", lambda t: F.abs(t["bin"] - F.col("bin")) <= MAX_BIN_GAP)
    out = out.select("signal_id", "frame", "bin", F.explode(F.slice(F.sort_array(near), 1, fan_out)).alias("t"))
    return out.select(
        "signal_id", F.col("frame").cast("long").alias("offset"), pair_hash(F.col("bin"), F.col("t.bin"), F.col("t.frame") - F.col("frame")).alias("hash"),
        F.col("t.frame").alias("target_frame"), F.col("t.bin").alias("target_bin"),
    )


def capped(index: DataFrame, key: str = "hash", cap: int = POSTING_CAP) -> DataFrame:
    """``index`` without the keys that have more than ``cap`` postings: all or nothing."""
    over = index.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > cap).select(key)
    return index.join(over, key, "left_anti")


def posting_lists(index: DataFrame, cap: int = POSTING_CAP) -> DataFrame:
    """hash, n_postings, postings array<struct<song_id, offset>>; no list is longer than the cap."""
    out = capped(index, "hash", cap).groupBy("hash").agg(F.sort_array(F.collect_list(F.struct("song_id", "offset"))).alias("postings"))
    return out.select("hash", F.size("postings").cast("long").alias("n_postings"), "postings")


def votes(samples: DataFrame, index: DataFrame) -> DataFrame:
    """sample_id, song_id, delta, votes, from samples (sample_id, hash, offset) and index (song_id, hash, offset)."""
    s = samples.select("sample_id", "hash", F.col("offset").alias("at"))
    both = s.join(index.select("song_id", "hash", "offset"), "hash")
    return both.groupBy("sample_id", "song_id", (F.col("offset") - F.col("at")).alias("delta")).agg(F.count("*").alias("votes"))


def best_delta(counted: DataFrame) -> DataFrame:
    """The delta of most votes of each (sample_id, song_id); of equals the smallest."""
    best = F.max(F.struct(F.col("votes"), (-F.col("delta")).alias("back"))).alias("b")
    return counted.groupBy("sample_id", "song_id").agg(best).select("sample_id", "song_id", (-F.col("b.back")).alias("delta"), F.col("b.votes").alias("votes"))


def ranked(best: DataFrame, k: int) -> DataFrame:
    """The k songs of most votes of each sample, with their rank; ties by delta, then song."""
    w = Window.partitionBy("sample_id").orderBy(F.desc("votes"), "delta", "song_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def match(samples: DataFrame, index: DataFrame, k: int = 5) -> DataFrame:
    """sample_id, rank, song_id, score, votes, delta: a whole batch of clips in one plan."""
    k = k if k > 0 else 5
    sizes = samples.groupBy("sample_id").agg(F.count("*").alias("n_hashes"))
    out = ranked(best_delta(votes(samples, index)), k).join(sizes, "sample_id")
    return out.select("sample_id", "rank", "song_id", (F.col("votes") / F.col("n_hashes")).alias("score"), "votes", "delta")


def margins(matches: DataFrame) -> DataFrame:
    """sample_id, margin: first score over second, 0 where there is no second."""
    of = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    out = matches.groupBy("sample_id").agg(of(1).alias("first"), of(2).alias("second"))
    return out.select("sample_id", F.when(F.col("second") > 0, F.col("first") / F.col("second")).otherwise(0.0).alias("margin"))


def similarity(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """sample_id, song_id, similarity: most sample entries that agree on one delta, over all entries, at most 1.

    An entry (entry_id) has one hash and offset.  Pairs of postings are as many as the square of what a hash has, so they
    are counted, not made: both sides' offsets meet in the task of their (sample, song), packed, hash by hash, and the
    counts of all deltas are the cross-correlation of the two lists, ``agreeing``.
    """
    own = samples.select("sample_id", "entry_id", "hash", F.col("offset").cast("long").alias("offset")).distinct()
    own = _packed(own, "sample_id")
    theirs = _packed(targets.select("song_id", "hash", F.col("offset").cast("long").alias("offset")).distinct(), "song_id")
    asked, held = own.select("sample_id", "hash").distinct(), theirs.select("song_id", "hash").distinct()
    rows = ["sample_id", "song_id", "hash", "role", "offsets"]
    both = own.join(held, "hash").withColumn("role", F.lit(0)).select(rows).unionByName(theirs.join(asked, "hash").withColumn("role", F.lit(1)).select(rows))
    both = both.repartition("sample_id", "song_id").sortWithinPartitions("sample_id", "song_id", "hash", "role")
    kinds = ", ".join(f"{n} {both.schema[n].dataType.simpleString()}" for n in ("sample_id", "song_id"))
    best = both.mapInArrow(_most_agreeing, f"{kinds}, n long")
    sizes = samples.groupBy("sample_id").agg(F.count("*").alias("n_entries"))
    return best.join(sizes, "sample_id").select("sample_id", "song_id", F.least(F.col("n") / F.col("n_entries"), F.lit(1.0)).alias("similarity"))


def _packed(postings: DataFrame, key: str) -> DataFrame:
    """key, hash and offsets array<long>, a row for each chunk of offsets."""
    some = postings.where("hash IS NOT NULL AND offset IS NOT NULL").groupBy(key, "hash", F.floor(F.col("offset") / CHUNK).alias("chunk"))
    return some.agg(F.collect_list("offset").alias("offsets")).drop("chunk")


class Agreeing:
    """How many entries of a sample agree on each delta with a song, summed over hashes; deltas from ``first`` on."""

    def __init__(self):
        self.first, self.counts = 0, np.zeros(0, np.int64)

    def add(self, own: np.ndarray, theirs: np.ndarray) -> None:
        """``own``: offsets of entries, repeated ones count; ``theirs``: distinct offsets; of one hash."""
        low, high = int(own.min()), int(theirs.min())
        width = int(own.max()) - low + int(theirs.max()) - high + 1
        counts = self._room(high - int(own.max()), width)
        if len(own) * len(theirs) <= DIRECT * width:
            step = max(1, 2**20 // len(theirs))
            for i in range(0, len(own), step):
                delta = np.subtract.outer(theirs - self.first, own[i : i + step]).ravel()
                at = int(delta.min())
                some = np.bincount(delta - at)
                self.counts[at : at + len(some)] += some
        else:  # the same sums by the Fourier transform, in steps that follow the width
            size = 1 << (width - 1).bit_length()
            a, b = np.bincount(int(own.max()) - own), np.bincount(theirs - high)
            counts += np.rint(np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)[:width]).astype(np.int64)

    def _room(self, first: int, width: int) -> np.ndarray:
        """The counts of ``width`` deltas from ``first`` on."""
        if not len(self.counts):
            self.first = first
        low, high = min(first, self.first), max(first + width, self.first + len(self.counts))
        if high - low > len(self.counts):  # twice the room it takes, so that it grows a few times only
            spare = (high - low) // 2
            counts, low = np.zeros(high - low + 2 * spare, np.int64), low - spare
            counts[self.first - low : self.first - low + len(self.counts)] = self.counts
            self.first, self.counts = low, counts
        return self.counts[first - self.first : first - self.first + width]


def _most_agreeing(batches):
    """sample_id, song_id, n: rows (sample_id, song_id, hash, role, offsets) come by pair, hash and role."""
    pair = at = None
    counts, sides = Agreeing(), ([], [])

    def settle():
        if sides[0] and sides[1]:
            counts.add(np.concatenate(sides[0]), np.concatenate(sides[1]))

    def row():
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*pair, int(counts.counts.max())), kinds, strict=True)], ["sample_id", "song_id", "n"])

    for b in batches:
        kinds = (b.column(0).type, b.column(1).type, pa.int64())
        lists, flat = b.column(4).offsets.to_numpy(), b.column(4).values.to_numpy()
        for i, (sample, song, key, role) in enumerate(zip(*(b.column(c).to_pylist() for c in range(4)), strict=True)):
            if (sample, song, key) != at:
                settle()
                if pair is not None and (sample, song) != pair:
                    yield row()
                    counts = Agreeing()
                pair, at, sides = (sample, song), (sample, song, key), ([], [])
            sides[role].append(flat[lists[i] : lists[i + 1]].copy())
    if pair is not None:
        settle()
        yield row()
