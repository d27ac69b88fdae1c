import random

import numpy as np
from brute import components, jaccard_at_least, shingle_set

from tessitura.llm import linking, near_dup
from tessitura.llm.minhash import odd_similarity, odd_sketches

SCHEMA = "doc_id long, text string, lang string, component_id long"


def family(seed, n, base_words, edits):
    r = random.Random(seed)
    base = [f"w{r.randint(0, 5000)}" for _ in range(base_words)]
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"x{r.randint(0, 10**6)}"
        yield " ".join(w)


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", -1) for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.query(docs).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    root = components(sets, lambda a, b: jaccard_at_least(sets[a], sets[b], 75))
    assert got == {i: (len(sets[i]), root[i], root[i] == i) for i in sets}


def test_families_against_all_pairs(spark):
    texts = [*family(1, 70, 90, 9), *family(2, 30, 300, 30), *family(3, 20, 12, 2), *family(4, 12, 4, 1)]
    texts += texts[:20] + ["", " \t ", None, "one two", "one two", "ONE two", "É a", "é a", "a b c d e f", "a b c d e g"]
    random.Random(5).shuffle(texts)
    check(spark, list(enumerate(texts)))


def small_limits(monkeypatch, outer=4):
    for name, value in (("OUTER", outer), ("INNER", 8), ("HOT_ROWS", 8), ("ONE_IN", 1), ("SALTS", 3)):
        monkeypatch.setattr(linking, name, value)
    monkeypatch.setattr(near_dup, "HOT_ROWS", 8)


def test_large_and_hot_buckets(spark, monkeypatch):
    small_limits(monkeypatch)
    monkeypatch.setattr(near_dup, "MOST_FLAGGED", -1)
    texts = [*family(7, 60, 60, 10), *family(8, 40, 200, 50)]
    texts += texts[:12] + [texts[0]] * 12
    random.Random(6).shuffle(texts)
    check(spark, list(enumerate(texts)))


def test_many_unlike_ids_of_one_bucket_cost_no_pairs(spark, monkeypatch):
    """Sets with a common half and a half of their own: no rare member is shared, so no set is sent to a block."""
    monkeypatch.setattr(linking, "OUTER", 16)
    sent = []
    blocks = linking._blocks
    monkeypatch.setattr(linking, "_blocks", lambda mixed, *a: sent.append(mixed.count()) or blocks(mixed, *a))
    r = np.random.default_rng(3)
    common = r.integers(0, 2**64, 40, dtype=np.uint64)
    sets = [(i, bytearray(np.sort(np.concatenate((common, r.integers(0, 2**64, 40, dtype=np.uint64)))).tobytes())) for i in range(400)]
    table = spark.createDataFrame(sets, "id long, set binary")
    rows = spark.createDataFrame([(1, i) for i, _ in sets], "key long, id long")
    assert linking.link(rows, lambda ids: table.join(ids, "id"), linking.as_hashes(75)).collect() == []
    assert sum(sent) == 0


def test_keys_of_text_clashing_names_nulls_and_repeated_keys(spark):
    schema = "doc_id string, text string, id long, rep long, component_id long, _gone string, kept boolean"
    texts = [("b", "a b c d e f g h"), ("a", "a b c d e f g h"), ("a", "q r s t u v w x y z"), ("c", "q r s t u v w x y z"), (None, "q r s t u v w x y z"), ("d", None), ("e", "")]
    docs = spark.createDataFrame([(*t, 1, 1, 1, "x", True) for t in texts], schema)
    got = sorted((r.doc_id or "-", r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect())
    # the larger of a's sets stands for it
    assert got == [("-", 6, None, True), ("a", 4, "a", True), ("a", 6, "a", True), ("b", 4, "b", True), ("c", 6, "a", False), ("d", 0, "d", True), ("e", 0, "e", True)]
    left = near_dup.keep_first(docs)
    assert left.columns == docs.columns and sorted(r.doc_id or "-" for r in left.collect()) == ["-", "a", "a", "b", "d", "e"]


def test_very_long_texts(spark):
    r = random.Random(9)
    words = [f"w{r.randint(0, 10**6)}" for _ in range(150_000)]
    other = list(words)
    for k in range(0, len(other), 50):
        other[k] = "x"
    docs = spark.createDataFrame([(1, " ".join(words), "en", 0), (2, " ".join(other), "en", 0), (3, " ".join(words[75_000:]), "en", 0)], SCHEMA)
    assert {x.doc_id: x.component_id for x in near_dup.query(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_empty_table(spark):
    assert near_dup.query(spark.createDataFrame([], SCHEMA)).collect() == []


def test_keep_first_keeps_columns(spark):
    docs = spark.createDataFrame([(2, "a b c d e f g", "en", 7), (1, "a b c d e f g", "de", 8), (3, None, None, None), (4, "", "x", 1)], SCHEMA)
    assert sorted(r.doc_id for r in near_dup.keep_first(docs).collect()) == [1, 3, 4]
    assert near_dup.keep_first(docs).columns == docs.columns


def test_odd_sketch_estimates_high_similarity():
    r = np.random.default_rng(0)
    a = r.integers(0, 2**32, (200, 160), dtype=np.uint32)
    b = np.where(r.random((200, 160)) < 0.8, a, r.integers(0, 2**32, (200, 160), dtype=np.uint32))
    got = odd_similarity(odd_sketches(a, 512), odd_sketches(b, 512), 160)
    assert abs(got.mean() - 0.8) < 0.03
    assert odd_similarity(odd_sketches(a, 512), odd_sketches(a, 512), 160).min() == 1
