import re

import pyarrow as pa
from pyspark.sql import functions as F

from tessitura.llm import bpe
from tessitura.llm.queries import byte_bpe_path


def test_workers_give_back_what_the_last_stage_freed(spark):
    def held(batches):
        for b in batches:
            with open("/proc/self/smaps_rollup") as f:
                mb = sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", f.read()))) // 1024
            yield pa.RecordBatch.from_arrays([pa.array([mb] * b.num_rows, pa.int64())], ["mb"])

    words = F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(200_000))))
    docs = spark.range(0, 6000, numPartitions=1).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))
    idle = lambda: max(r.mb for r in spark.range(0, 8, numPartitions=4).mapInArrow(held, "mb long").collect())
    before = idle()
    assert bpe.query(docs, byte_bpe_path()).agg(F.sum("n_tokens")).first()[0] > 6000 * 300
    assert idle() - before < 200
