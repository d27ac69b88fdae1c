"""Benchmark items with many changed words, and short ones with one."""

import random

import pyarrow as pa

from tessitura.llm import decontaminate


def found(item, passage):
    text = " ".join([*(f"a{i}" for i in range(30)), *passage, *(f"b{i}" for i in range(30))])
    return bool(decontaminate.Seeds([1], [" ".join(item)]).search(pa.array([text])))


def words(n):
    return [f"w{i}" for i in range(n)]


def test_every_third_word_changed():
    assert found(words(38), [w if i % 3 != 2 else f"x{i}" for i, w in enumerate(words(38))])


def test_two_runs_of_nine_on_one_diagonal():
    assert found(words(23), [w if not 9 <= i < 14 else f"x{i}" for i, w in enumerate(words(23))])


def test_short_items_with_any_one_word_changed():
    for n in range(5, 12):
        for k in range(n):
            assert found(words(n), [w if i != k else "x" for i, w in enumerate(words(n))]), (n, k)


def test_words_changed_at_random():
    r = random.Random(3)
    for changed, least in ((4, 198), (5, 195)):
        hits = 0
        for _ in range(200):
            out = set(r.sample(range(20), changed))
            hits += found(words(20), [w if i not in out else f"x{i}" for i, w in enumerate(words(20))])
        assert hits >= least, (changed, hits)


def test_less_than_half_is_not_found():
    assert not found(words(18), [w if i % 2 == 0 else f"x{i}" for i, w in enumerate(words(18))])
