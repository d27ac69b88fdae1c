"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names and keys of text, for operators and stages."""

import corpus_pipeline
import pytest

from tessitura.llm import bpe, decontaminate, line_dedup, near_dup, pitman_yor, quality_classifier, quality_rules, substring_dedup
from tessitura.llm.queries import byte_bpe_path

DATA = "/root/testdata/sf0.001"
CLASHING = ["id", "row", "text_", "_row", "_gone", "_key", "_doc", "_mark", "_lines", "mark", "numbers", "component", "rep", "n_words", "vote_lines", "size", "held", "block", "item_id", "first_word", "starts", "ids"]
PROSE = " ".join(f"word{i} and more of it" for i in range(40))
LONG = " ".join(f"w{i * 7919 % 100_003}" for i in range(60_000))
ROWS = [("a", PROSE), ("a", PROSE), ("b", PROSE.upper()), (None, PROSE + " end"), ("c", None), ("d", ""), ("e", " \n\t"), ("f", LONG), ("g", "short line"), ("h", "short line\nshort line")]


def table(spark, kind, rows=ROWS):
    """Keys of text or long; all columns that an operator might use for itself."""
    number = {k: i for i, k in enumerate("abcdefgh")}
    data = [((k if kind == "string" else number.get(k)), t, "en", "s", len(t or ""), *("x" for _ in CLASHING)) for k, t in rows]
    return spark.createDataFrame(data, ", ".join([f"doc_id {kind}", "text string", "lang string", "source string", "n_chars long", *(f"`{c}` string" for c in CLASHING)]))


OPERATORS = {
    "op1": pitman_yor.query,
    "op2": quality_rules.query,
    "op3": substring_dedup.query,
    "op5": lambda docs: decontaminate.query(docs, docs.sparkSession.createDataFrame([(1, PROSE, "x"), (2, None, "x"), (3, "", "x"), (1, PROSE, "x")], "item_id int, text string, doc_id string")),
    "op6": lambda docs: bpe.query(docs, byte_bpe_path()),
    "op8": line_dedup.query,
    "op9": quality_classifier.query,
    "op10": near_dup.query,
}


@pytest.mark.parametrize("kind", ["string", "long"])
@pytest.mark.parametrize("name", OPERATORS)
def test_operators(spark, name, kind):
    docs = table(spark, kind)
    got = OPERATORS[name](docs).collect()
    if name == "op5":
        # the item is there twice, and three rows with a key hold it, two of them equal, and one without a key
        assert len(got) == 8
    else:
        assert len(got) == len(ROWS)
    for k in ("a", 0):
        same = [tuple(r)[1:] for r in got if r.doc_id == k]
        assert not same or len(set(same)) == 1
    assert OPERATORS[name](docs.limit(0)).collect() == []


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages(spark, stage):
    name, run = stage
    docs = table(spark, "long")
    got = run(spark, docs, DATA)
    if name != "bpe":
        assert got.columns == docs.columns
        assert {r["_gone"] for r in got.select("_gone").collect()} <= {"x"}
    keys = [r.doc_id for r in got.select("doc_id").collect()]
    if name == "quality_rules":
        assert not set(keys) & {2, 3, 4, 6, 7}  # too few words
    elif name == "near_dedup":
        assert sorted(keys, key=str) == [0, 0, 2, 3, 4, 5, 6, 7, None]  # 1 is like 0
    else:
        assert len(keys) == len(ROWS)
    if name == "line_dedup":
        assert got.where("doc_id = 7").first().text == "" and got.where("doc_id = 2").first().text is None
    assert run(spark, docs.limit(0), DATA).count() == 0
