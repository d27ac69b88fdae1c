"""What every sweep of op1 asks for again is computed once, and bigrams are numbered in little memory."""

import tracemalloc

import numpy as np

from tessitura.llm import pitman_yor, seating


def test_sweeps_compute_the_outline_of_a_large_dish_once(monkeypatch):
    asked = []
    s = seating.Stirling(0.7)
    monkeypatch.setattr(seating, "stirling", lambda discount: s)
    log = s.log
    monkeypatch.setattr(s, "log", lambda c, t: asked.append((c, len(t), int(t[-1] - t[0]) + 1)) or log(c, t))
    c, rng = np.array([1, 5000, 5000, 1, 9000, 3]), np.random.default_rng(1)
    for _ in range(4):
        t = seating.tables(c, np.full(len(c), 0.5), 0.7, rng)
        assert (t >= 1).all() and (t <= c).all() and t[0] == t[3] == 1
    assert sorted(x for x, n, wide in asked if wide > n) == [5000, 9000]  # grids have gaps, windows have none


def test_series_of_neighbouring_counts_equal_scattered_ones():
    s = seating.Stirling(0.7)
    t = np.arange(40, 300)
    assert np.array_equal(s._series(20_000, t)[0], np.concatenate([s._series(20_000, t[i : i + 1])[0] for i in range(len(t))])) or np.allclose(s.log(20_000, t), [s.log(20_000, t[i : i + 1])[0] for i in range(len(t))], rtol=1e-9)


def test_numbers_of_distinct_values_in_less_memory():
    def peak(f):
        tracemalloc.start()
        out = f(x)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most

    x = np.random.default_rng(2).integers(0, 300_000, 400_000)
    (a, i), most = peak(lambda v: np.unique(v, return_inverse=True))
    (b, j), less = peak(pitman_yor.distinct_of)
    assert np.array_equal(a, b) and np.array_equal(i, j) and less < most
    assert [v.tolist() for v in pitman_yor.distinct_of(x[:0])] == [[], []]
