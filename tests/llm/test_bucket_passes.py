import numpy as np

from tessitura.llm import linking


def test_rows_of_a_large_bucket_are_joined_twice(spark, monkeypatch):
    """Once to find that it is mixed, once more after another pivot was drawn."""
    real, made = linking.joined, []

    def counted(rows, few, on, *more):
        out = real(rows, few, on, *more)
        if on == ["key"] and "p" not in few.columns:  # a draw's join makes only the pairs that are tested
            made.append(out.count())
        return out

    monkeypatch.setattr(linking, "joined", counted)
    n = linking.OUTER + 100
    rows = spark.range(n).selectExpr("5L AS key", "id")
    sets = [bytearray(np.arange(3 * (i % 2) + 1, 3 * (i % 2) + 4, dtype=np.uint64).tobytes()) for i in range(n)]
    table = spark.createDataFrame(list(enumerate(sets)), "id long, set binary")
    got = linking.link(rows, lambda ids: table.join(ids, "id"), linking.as_hashes(75))
    assert {r.id: r.component for r in got.collect()} == {i: i % 2 for i in range(n)}
    assert made.count(n) <= 2


def test_pivots_of_hot_keys_are_put_together_without_a_join(spark):
    rows = spark.range(400).selectExpr("id % 2 AS key", "id DIV 2 AS id")
    out = linking.crowded(rows, [0, 1], lambda df, what: df)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect())) == sorted((k, i, 0) for k in (0, 1) for i in range(200))
