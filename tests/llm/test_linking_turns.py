"""Pivots that are drawn again."""

import numpy as np
from pyspark.sql import functions as F

from tessitura.llm import linking


def test_a_pivot_drawn_again_does_not_end_the_search(spark):
    # id 1 is like neither 2 nor 3, which are alike; a key whose first draw is 1 again
    draws = spark.range(200).select(F.col("id").alias("key"), *(F.xxhash64("id", F.lit(i).cast("long"), F.lit(0)).alias(f"h{i}") for i in (1, 2, 3)))
    key = draws.where("h1 > h2 AND h1 > h3").agg(F.min("key")).first()[0]
    rows = spark.createDataFrame([(key, i) for i in (1, 2, 3)], "key long, id long")
    sets = {1: [1, 2, 3], 2: [7, 8, 9], 3: [7, 8, 9]}
    table = spark.createDataFrame([(i, bytearray(np.array(x, np.uint64).tobytes())) for i, x in sets.items()], "id long, set binary")
    got = linking.link(rows, lambda ids: table.join(ids, "id"), linking.as_hashes(75))
    assert {(r.id, r.component) for r in got.collect()} == {(2, 2), (3, 2)}
