"""The whole pipeline against plain versions of its five stages, row by row."""

import hashlib

import corpus_pipeline
import duckdb
import numpy as np
from brute import components, contaminations, jaccard_at_least, lines_left, shingle_set
from tokenizers import Tokenizer

from tessitura.llm import quality_rules
from tessitura.llm.queries import byte_bpe_path

DATA = "/root/testdata/sf0.001"


def test_rows_equal_those_of_plain_stages(spark, tmp_path):
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    base = docs.orderBy("doc_id").limit(110).collect()
    rows = [tuple(r) for r in base]
    n = max(r.doc_id for r in base) + 1
    # more of what the later stages catch: near copies, common lines with a change, passages
    items = [r.text for r in bench.orderBy("item_id").collect()]
    for k, r in enumerate(base[:30]):
        words = (r.text or "").split()  # on one line, so that the line stage leaves it
        if len(words) > 60:
            words[30] = "changed"
            rows.append((n + 3 * k, " ".join(words), r.lang, r.source, r.n_chars))
            rows.append((n + 3 * k + 1, f"{r.text}\nA line that many of these documents share, number {k % 4}.", r.lang, "x", None))
            rows.append((n + 3 * k + 2, f"{r.text[::-1]} {items[k]} {r.text[::-1][:300]}", r.lang, None, 5))
    rows += [(n + 500, None, None, None, None), (n + 501, "", "en", "s", 0)]
    spark.createDataFrame(rows, docs.schema).write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = con.execute(quality_rules.oracle_sql()).fetchall()
    kept = {r[0] for r in sql if r[-1]}
    texts = {r[0]: r[1] for r in rows if r[0] in kept}
    assert 0 < len(texts) < len(rows)
    lines = lines_left(sorted(texts.items()))
    assert sum(k for k, _ in lines.values()) > 10
    texts = {i: t for i, (_, t) in lines.items()}
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = components(sets, lambda a, b: jaccard_at_least(sets[a], sets[b], 75))
    alone = {i: t for i, t in texts.items() if root[i] == i}
    assert len(alone) < len(texts)
    bad = {i for i, _ in contaminations(alone, dict(enumerate(items)))}
    clean = {i: t for i, t in alone.items() if i not in bad}
    assert len(clean) < len(alone)
    codec = Tokenizer.from_file(byte_bpe_path())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for i, t in clean.items():
        ids = codec.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(codec.decode(ids, skip_special_tokens=False).encode()))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want
