"""Quality rules, chat formatting, BPE, WARC, and the pipeline."""

import hashlib

import duckdb
import pytest

from tessitura.llm import bpe, chat_format, quality_rules, warc_audit
from tessitura.llm.queries import ORACLE_SQL, QUERIES, byte_bpe_path

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    want = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


def repeat_words(w):
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    return len({i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)})


def test_rule_counts(spark):
    texts = ["", None, "a", "a b", "a b c", "a b c a b c", "x x x x x", "one\x0btwo\x0cthree\rfour\tfive", "l1 w\nl1 w\n\n \nl1 w", "#*$%&|<> é ", " nbsp stays ", "a b c d a b c e a b"]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_words long")
    got = {r.doc_id: r for r in quality_rules.query(docs).collect()}
    for i, t in enumerate(texts):
        w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")]
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert tuple(got[i])[1:6] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), repeat_words(w)), t
        assert got[i].base_failed and not got[i].kept
    assert quality_rules.query(docs.limit(0)).collect() == []


def test_quality_rules_against_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_rules.judge(docs).join(labels, "doc_id").where("NOT base_failed").selectExpr("kept", "quality").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.98 * len(rows)


def test_quality_rules_stay_in_the_jvm(spark):
    plan = quality_rules.query(spark.read.parquet(f"{DATA}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_chats(spark):
    rows = [(1, 2, "assistant", "<|end|> <~ << <|"), (1, 1, "user", "hi"), (1, 3, "assistant", "more"), (2, 1, "a<|text|>b", None), (2, 1, None, "tie"), (3, None, "assistant", ""), (None, 1, "user", "x"), (4, 1, "assistant", "é" * 2000)]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat_format.query(turns).collect()}
    assert set(got) == {1, 2, 3, 4, None, -7}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\nhi\nassistant\n<|end|> <~ << <|\nassistant\nmore\n") and got[1].n_turns == 3
    assert got[1].loss_sha256 == sha("<|end|> <~ << <|more") and got[1].loss_chars == 20
    assert got[2].turns_sha256 == sha("\ntie\na<|text|>b\n\n") and got[3].loss_chars == 0 and got[4].loss_chars == 2000
    assert {r.conv_id for r in chat_format.query(turns.limit(0)).collect()} == {-7}
    text = chat_format.format_chats(turns.where("conv_id = 1")).first().formatted
    assert text == "<|open|>user<|text|>hi<|end|><|open|>assistant<|text|><~|end|> <~~ <~<~ <~|<|next|>more<|end|>"


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(byte_bpe_path())
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + [r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    texts += ["", None, "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "don't  we'll\n\n x \x1c\x1d", " a　b", "a" * 5000, "\U0001f600 é́ ½٠"]
    docs = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    coded = {r.doc_id: r.ids for r in bpe.encode(docs, byte_bpe_path()).collect()}
    for i, e in enumerate(ref.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert coded[i] == e.ids
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, byte_bpe_path()), byte_bpe_path()).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert all(r.same for r in bpe.round_trip(docs, byte_bpe_path()).collect())
    assert bpe.query(docs.limit(0), byte_bpe_path()).collect() == []


def test_bpe_speculation_repairs_what_greedy_gets_wrong():
    c = bpe.Codec(byte_bpe_path())
    words = [w.encode() for w in (' inglyin', ' tinded', ' ONANEA', 'straightforwardlyish', 'ŝtrañge')]
    assert c.encode_words(words) == [c.merge(w) for w in words]
    assert any(c.propose(w) != c.merge(w) for w in words) and c.repaired > 0


def test_warc_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>é\r\n\r\nx</p>"), (5000, None, ""), (2, "http://b/", None), (4095, "u", "y" * 9000)], "page_id long, url string, html string")
    records = warc_audit.to_records(pages)
    warc_audit.write_files(records, str(tmp_path / "w"))
    got = {r.record_id: r for r in warc_audit.read_files(spark, str(tmp_path / "w")).collect()}
    assert {k: v.html for k, v in got.items()} == {1: "<p>é\r\n\r\nx</p>", 5000: "", 2: "", 4095: "y" * 9000}
    where = {r.record_id: (r.offset, r.length) for r in warc_audit.index(records).collect()}
    assert where == {k: (v.offset, v.length) for k, v in got.items()}


def test_audit_finds_exactly_the_damage(spark):
    left = [(i, f"u{i}", "x" * (i % 7)) for i in range(0, 9000, 3)] + [(-5, "n", "n"), (None, "q", "q"), (12, "u12", "second"), (12, "u12", "second")]
    right = [r for r in left if r[0] != 300] + [(10**12, "new", "new")]
    right = [(k, u, "changed" if k == 4095 else h) for k, u, h in right]
    schema = "page_id long, url string, html string"
    out = warc_audit.report(*(warc_audit.to_records(spark.createDataFrame(x, schema)) for x in (left, right)))
    bad = {r.record_id: r.status for r in out.where("status != 'ok'").collect()}
    assert bad == {300: "missing", 4095: "corrupt", 10**12: "extra"}
    none = spark.createDataFrame([], schema)
    assert warc_audit.report(warc_audit.to_records(none), warc_audit.to_records(none)).collect() == []


def test_audit_of_written_files_finds_bytes_that_changed_or_moved(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}\r\nX: y", "z" * (i % 50)) for i in range(300)] + [(None, None, "")], "page_id long, url string, html string")
    records = warc_audit.to_records(pages)
    for name in ("left", "right"):
        warc_audit.write_files(records, str(tmp_path / name))
    read = lambda n: warc_audit.read_files(spark, str(tmp_path / n)).where("record_id IS NOT NULL").select("record_id", "record")
    assert {r.status for r in warc_audit.report(records, read("right")).collect()} == {"ok"}
    [part] = [p for p in (tmp_path / "right" / "file=0").glob("part-*") if b"record:100>" in p.read_bytes()]
    raw = part.read_bytes()
    at = raw.index(b"record:100>")
    at = raw.index(b"\r\n\r\n", at) + 4
    part.write_bytes(raw[:at] + b"Z" + raw[at + 1 :])
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    assert {r.record_id for r in warc_audit.report(read("left"), read("right")).where("status != 'ok'").collect()} == {100}
    # a record that lost a byte is badly framed; the others are found all the same
    part.write_bytes(raw[:at] + raw[at + 1 :])
    bad = {r.record_id: r.status for r in warc_audit.report(read("left"), read("right")).where("status != 'ok'").collect()}
    assert bad == {100: "missing"}


def test_audit_query_on_nulls_equals_sql(spark, tmp_path):
    spark.createDataFrame([(13, "u", ""), (110, None, "x"), (5, "v", "y"), (None, "w\r\nWARC-Type: x", None), (97 + 13 + 97, "q", "abc")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["op7_warc_audit"])
    names = [c[0] for c in want.description]
    got = QUERIES["op7_warc_audit"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
