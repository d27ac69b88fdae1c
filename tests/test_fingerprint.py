import numpy as np
import pytest
from signals import tune

from tessitura.operators import constellation, spectrum, subband
from tessitura.operators.fingerprint import find_peaks, frames, hashes, n_frames, peaks, spectra
from tessitura.params import Params
from tessitura.sources.datasource import pairs_of


def grid(shape, cells):
    x = np.zeros(shape)
    for at, v in cells.items():
        x[at] = v
    return x


@pytest.mark.parametrize("x, radii, floor, want", [
    (grid((7, 9), {(0, 8): 3, (6, 0): 2}), (1, 3), 0.5, [(0, 8), (6, 0)]),  # corners
    (grid((7, 9), {(3, 4): 0.25}), (1, 1), 0.25, []),  # at the floor is not above it
    (grid((12, 9), {(2, 4): 5, (5, 4): 5, (9, 4): 6}), (3, 1), 0, [(9, 4)]),  # equals within reach put each other out
    (grid((12, 9), {(2, 4): 5, (6, 4): 5}), (3, 1), 0, [(2, 4), (6, 4)]),  # just out of reach
    (grid((6, 30), {(2, 10): 4, (2, 13): 3, (2, 17): 2}), (2, 3), 0, [(2, 10), (2, 17)]),  # a slope in one frame
    (np.full((5, 6), 0.7), (1, 1), 0, []),  # a plain
])
def test_peak_grids(spark, x, radii, floor, want):
    assert [tuple(p) for p in find_peaks(x, *radii, floor).tolist()] == want
    cells = spark.createDataFrame([(0, f, b, float(v)) for (f, b), v in np.ndenumerate(x)], "signal_id long, frame int, bin int, mag double")
    assert sorted((r.frame, r.bin) for r in spectrum.peaks(cells, *radii, floor).collect()) == want


def test_peaks_against_nested_loops():
    x = np.random.default_rng(2).random((60, 80)).round(2)
    want = [(f, b) for f in range(60) for b in range(80) if all(x[f, b] > v for (i, j), v in np.ndenumerate(x[max(f - 5, 0) : f + 6, max(b - 12, 0) : b + 13]) if (i + max(f - 5, 0), j + max(b - 12, 0)) != (f, b)) and x[f, b] > 0]
    assert [tuple(p) for p in find_peaks(x, 5, 12).tolist()] == want


def test_frame_count_leaves_the_last_full_frame_out():
    p = Params()
    assert n_frames(5 * 44100, p) == 428 and n_frames(1024 + 511, p) == 0 and n_frames(1024 + 512, p) == 1


def test_pairing_against_a_plain_loop_over_chunk_borders(spark, monkeypatch):
    monkeypatch.setattr(constellation, "CHUNK", 64)
    r = np.random.default_rng(3)
    p = sorted({(int(f), int(b)) for f, b in zip(r.integers(0, 500, 900), r.integers(0, 200, 900), strict=True)})
    want = sorted((f, b, t, c) for i, (f, b) in enumerate(p) for t, c in [(t, c) for t, c in p[i + 1 :] if 2 <= t - f <= 60 and abs(c - b) <= 64][:5])
    df = spark.createDataFrame([(1, f, b) for f, b in p], "signal_id long, frame int, bin int")
    assert sorted((r.offset, r.hash & 1023, r.target_frame, r.target_bin) for r in constellation.pair_hashes(df).collect()) == want


def test_long_recordings_in_spans_equal_one_piece(spark, monkeypatch):
    from tessitura.operators import fingerprint

    monkeypatch.setattr(fingerprint, "SPAN", 50)
    x, p = tune(4, 3), Params()
    df = spark.createDataFrame([(7, x.tolist())], "song_id long, samples array<double>")
    assert sorted((r.frame, r.bin) for r in peaks(df, p).collect()) == [tuple(v) for v in find_peaks(spectra(x, p), 5, 12).tolist()]
    assert sorted((r.hash, r.offset) for r in hashes(df, p).collect()) == sorted(pairs_of(x, p))
    bits = [r.bits for r in frames(df, p).orderBy("frame").collect()]
    assert len(bits) == n_frames(len(x), p)


def test_gain_changes_nothing():
    x, p = tune(5, 2), Params()
    assert pairs_of(x, p) == pairs_of(x * 0.25, p)


def test_a_clip_moved_by_whole_hops_moves_its_offsets():
    x, p = tune(6, 3), Params()
    whole, part = set(pairs_of(x, p)), pairs_of(x[40 * 512 :], p)
    assert sum((h, o + 40) in whole for h, o in part) > 0.8 * len(part)


def test_mel_edges_are_the_published_ones():
    want = "0 1 3 5 7 9 11 13 16 19 22 25 29 33 37 42 47 53 59 65 73 80 89 98 108 120 132 145 159 174 191 210 230 252 275 301 329 360 393 429 469 512"
    assert subband.mel_edges(1024, 44100) == [int(v) for v in want.split()]


@pytest.mark.parametrize("bad", [{"win_size": 1000}, {"win_size": 0}, {"hop_size": 0}, {"window_func": "flat"}, {"algo": "other"}])
def test_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        Params(**bad)


def test_noise_depends_on_the_seed_only(spark):
    s = spark.range(2000).selectExpr("id % 2 AS signal_id", "id div 2 AS pos", "sin(id) AS sample")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(spectrum.with_noise(s, 0.1, 3)) == rows(spectrum.with_noise(s.repartition(7), 0.1, 3)) != rows(spectrum.with_noise(s, 0.1, 4))


def test_saturated_keys_go_all_or_nothing(spark):
    index = spark.range(10_100).selectExpr("1L AS hash", "id AS offset", "0L AS song_id").union(spark.range(10_000).selectExpr("2L", "id", "0L"))
    assert constellation.capped(index).groupBy("hash").count().collect() == [(2, 10_000)]
