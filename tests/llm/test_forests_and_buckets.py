import numpy as np
import pyarrow as pa
import pytest

from tessitura.llm import linking


@pytest.mark.parametrize("most", [2**20, 500, 0])
def test_components_by_one_task_and_by_rounds(spark, monkeypatch, most):
    monkeypatch.setattr(linking, "TASK_EDGES", most)
    pairs = np.random.default_rng(3).integers(0, 3000, (1400, 2))
    pairs = np.vstack([pairs, np.column_stack((np.arange(4000, 4200), np.arange(4001, 4201)))])
    pairs = pairs[pairs[:, 0] != pairs[:, 1]].tolist()
    parent = {x: x for pair in pairs for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = linking.components(spark.createDataFrame([tuple(p) for p in pairs], "a long, b long").repartition(5), [])
    assert {r.id: r.component for r in got.collect()} == {x: root(x) for x in parent}


@pytest.mark.parametrize("width", [1, 2, 7, 1000])
def test_company_streams_keys_over_batches(width):
    rng = np.random.default_rng(width)
    rows = sorted(zip(rng.integers(-20, 60, 300).tolist(), rng.integers(0, 9, 300).tolist(), strict=True), key=lambda r: r[0])
    rows += [(100, 5), (101, 5), (101, 5)]  # one id only, also when it is repeated
    ids = {}
    for k, i in rows:
        ids.setdefault(k, set()).add(i)
    for hot in ([], [100]):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[s : s + width], strict=True)], ["key", "id"]) for s in range(0, len(rows), width)]
        got = [tuple(r.values()) for b in linking.company(hot)(iter(batches)) for r in b.to_pylist()]
        assert sorted(got) == sorted((k, i, min(v)) for k, v in ids.items() if len(v) > 1 or k in hot for i in v)


def test_crowded_puts_the_pivots_of_hot_keys_together(spark):
    rows = [(1, i) for i in range(200)] + [(2, 7), (2, 7), (3, 8), (3, 9), (4, 5)]
    got = linking.crowded(spark.createDataFrame(rows * 2, "key long, id long"), [1, 2], lambda df, what: df)
    assert sorted(map(tuple, got.collect())) == sorted([(1, i, 0) for i in range(200)] + [(3, 8, 8), (3, 9, 8)])
