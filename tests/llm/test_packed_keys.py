import numpy as np
import pyarrow as pa
import pytest

from tessitura.llm import linking


@pytest.mark.parametrize("hot", [[], [3, -7]])
def test_packed_keys_come_back_by_part_in_fewer_bytes(hot):
    rng = np.random.default_rng(8)
    keys, ids = rng.integers(-50, 50, 5000), rng.integers(-(2**62), 2**62, 5000)
    b = linking.packed(keys, ids, 24, hot)
    places = {}
    for part, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
        for k in np.frombuffer(raw, np.int64).tolist():
            places.setdefault(k, set()).add(part)
    assert all((len(p) > 1) == (k in hot) for k, p in places.items())
    got = pa.Table.from_batches(linking.unpacked([b]))
    assert sorted(zip(*(got.column(c).to_pylist() for c in range(2)), strict=True)) == sorted(zip(keys.tolist(), ids.tolist(), strict=True))
    assert b.nbytes < 17 * len(keys)  # a row of two longs takes 24 and its length
    assert linking.packed(keys[:0], ids[:0], 24, hot).num_rows == 0


def test_crowded_takes_packed_rows_as_it_takes_plain_ones(spark):
    rng = np.random.default_rng(9)
    keys, ids = rng.integers(0, 300, 900), rng.integers(0, 60, 900)
    plain = spark.createDataFrame(list(zip(keys.tolist(), ids.tolist(), strict=True)), "key long, id long")

    def rows(parts, hot):
        def run(batches):
            for b in batches:
                yield linking.packed(b.column(0).to_numpy(), b.column(1).to_numpy(), parts, hot)

        return plain.mapInArrow(run, "part int, keys binary, ids binary")

    kept = lambda df, what: df.cache()
    for hot in ([], [5, 6]):
        a, b = (sorted(map(tuple, linking.crowded(x, hot, kept).select("key", "id", "pivot").collect())) for x in (plain, rows))
        assert a == b and a
