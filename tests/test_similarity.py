"""Similarity of many postings: every pair of postings counts, and none is a row."""

import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.operators import constellation

SCHEMA = "signal_id long, hash long, offset long"


def both(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select(F.col("signal_id").alias("sample_id"), "hash", "offset", F.struct("offset", "hash").alias("entry_id")), df.withColumnRenamed("signal_id", "song_id")


@pytest.mark.parametrize("direct", [0, 8, 10**9])
def test_similarity_against_a_plain_loop(direct):
    r = np.random.default_rng(5)
    lists = [(np.sort(r.integers(-50, 4000, n)), np.unique(r.integers(low, low + 3000, m))) for n, m, low in ((1, 1, 9000), (700, 900, 0), (40, 3, 70000), (2000, 2500, -9000))]
    old, constellation.DIRECT = constellation.DIRECT, direct
    try:
        x = constellation.Agreeing()
        for own, theirs in lists:
            x.add(own, theirs)
    finally:
        constellation.DIRECT = old
    want = Counter(int(t - o) for own, theirs in lists for t in theirs for o in own)
    assert {x.first + int(i): int(x.counts[i]) for i in np.flatnonzero(x.counts)} == dict(want)


def test_similarity_over_chunks_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(constellation, "CHUNK", 16)
    r = np.random.default_rng(6)
    rows = [(int(s), int(h), int(o)) for s, h, o in zip(r.integers(0, 4, 900), r.integers(0, 5, 900) ** 2, r.integers(0, 300, 900), strict=True)] + [(9, 77, 5)]
    got = {(x.sample_id, x.song_id): x.similarity for x in constellation.similarity(*both(spark, rows)).collect()}
    sizes, agreed = Counter(s for s, _, _ in rows), {}
    for s, h, o in rows:
        for t, g, p in rows:
            if g == h:
                agreed.setdefault((s, t), {}).setdefault(p - o, set()).add((o, h))
    assert got == {k: min(max(map(len, d.values())) / sizes[k[0]], 1.0) for k, d in agreed.items()}


def test_similarity_of_a_hash_with_many_postings(spark):
    df = spark.range(200_000).select((F.col("id") % 2).alias("signal_id"), F.lit(7).cast("long").alias("hash"), F.floor(F.col("id") / 2).alias("offset"))
    samples, songs = df.select(F.col("signal_id").alias("sample_id"), "hash", "offset", F.struct("offset", "hash").alias("entry_id")), df.withColumnRenamed("signal_id", "song_id")
    began = time.monotonic()
    assert {tuple(x) for x in constellation.similarity(samples, songs).collect()} == {(a, b, 1.0) for a in (0, 1) for b in (0, 1)}
    assert time.monotonic() - began < 120  # 4e10 pairs of postings, were they rows
