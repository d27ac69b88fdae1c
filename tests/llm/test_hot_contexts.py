"""Contexts that are dealt to several shards."""

import random

import numpy as np
import pyarrow as pa

from tessitura.llm import pitman_yor
from tessitura.llm.common import hash_strings


def test_scores_do_not_depend_on_the_block(spark, monkeypatch):
    r = random.Random(6)
    texts = [" ".join(f"the w{r.randrange(60)}" for _ in range(8)) for _ in range(24)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    hot = {int(hash_strings(pa.array(["the"]))[0]): 6}
    monkeypatch.setattr(pitman_yor, "hot_words", lambda blocks, shards: hot)
    one = {x.doc_id: x.score for x in pitman_yor.query(docs).collect()}
    monkeypatch.setattr(pitman_yor, "BLOCK", 1)
    two = {x.doc_id: x.score for x in pitman_yor.query(docs).collect()}
    assert np.allclose([one[i] for i in range(24)], [two[i] for i in range(24)], rtol=1e-5)
