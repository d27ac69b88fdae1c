import pytest
from pyspark.sql import functions as F

from tessitura.llm import line_dedup, linking, near_dup

WORDS = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture
def plain(spark):
    """No broadcast by size, as on large tables, and a plan that keeps its counts."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def shuffled(df):
    """Rows that the exchanges of ``df`` wrote, the most of one."""
    found, left = [0], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        if node.nodeName() == "Exchange":
            found.append(node.metrics().get("shuffleRecordsWritten").get().value())
        left += [node.children().apply(i) for i in range(node.children().size())]
    return max(found)


@pytest.mark.parametrize("few", [0, 1000])
def test_documents_that_lose_no_line_are_not_shuffled(plain, monkeypatch, few):
    monkeypatch.setattr(line_dedup, "FEW", few, raising=False)
    rows = [(i, "\n".join(f"{i * 7919 % 1009} {i * k * 31 % 997} line {k} of text {i} {i * i * k % 991}" for k in range(3))) for i in range(400)]
    rows += [(400 + i, f"a line of its own, number {i * 7907 % 1013} {WORDS}\nthe very same line stands here") for i in range(0, 5)]
    docs = plain.createDataFrame([*rows, (None, "the very same line stands here"), (500, None)], "doc_id long, text string")
    out = line_dedup.drop_lines(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == docs.count() and got[401].n_lines_removed and got[None].n_lines_removed == 0 and got[500].text is None
    assert shuffled(out) < 200


@pytest.mark.parametrize("few", [0, 1000])
def test_documents_that_stay_are_not_shuffled(plain, monkeypatch, few):
    monkeypatch.setattr(near_dup, "FEW", few, raising=False)
    rows = [(f"k{i:03}", " ".join(f"w{i * 100 + k}" for k in range(12)), 1) for i in range(400)]
    rows += [("k400", WORDS, 2), ("k401", WORDS, 3), ("k402", WORDS + " ", 4), (None, WORDS, 5)]
    docs = plain.createDataFrame(rows, "key string, text string, `a.b` int")
    out = near_dup.keep_first(docs, "key", "text")
    got = sorted(out.collect(), key=str)
    assert got == sorted((r for r in docs.collect() if r.key not in ("k401", "k402")), key=str) and out.columns == docs.columns
    assert shuffled(out) < 50


def test_rows_apart(spark):
    rows = spark.range(-3000, 3000).select(F.expr("id * 7919 * 104729 AS x"), "id").unionByName(spark.sql("SELECT CAST(null AS long) AS x, 9999L AS id"))
    ids = rows.where("id % 10 = 3").select("x")
    some, others = (sorted(r.id for r in df.collect()) for df in linking.apart(rows, "x", ids))
    assert sorted(some + others) == sorted([*range(-3000, 3000), 9999]) and 9999 in others
    assert {r.id for r in rows.where("id % 10 = 3").collect()} <= set(some) and len(some) < 1500
    some, others = linking.apart(rows, "x", ids.limit(0))
    assert some.isEmpty() and others.count() == 6001
