"""WARC records and a Merkle audit of their replicas.

Records are written in order of their key; record keys fall into files of
``2 ** (BITS * FILE_LEVELS)`` consecutive keys.  Over the keys stands a hash tree of
fan-out ``2 ** BITS``: a leaf hashes the bytes of one record; a node hashes, in order, its
children's numbers, the byte range of each from the node's own start, and their hashes; a
file is a node, the root is the last.  Ranges are counted from the node's start, so a
record that has grown changes the nodes above it and no others.  Two replicas are compared
from the root; only children of nodes that differ are looked at below, so where replicas
agree the audit reads one row.

Every level is a group of at most ``2 ** BITS`` children, so no task gathers more,
whatever the size or skew of the archive.  Rows of one key are told apart by a number
within the key (ordered by their bytes); a key with many rows is first reduced to
one leaf by an order-free sum of record hashes, which is a partial aggregation.

Defined results: a null url or html counts as empty; line ends and other control characters
in a url are written as their percent codes, so that no url can end a header; a null key is
the key -1, together with rows of that key; other columns are ignored, whatever their
names; very long records are one string each; an empty table gives an empty report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import written

BITS, FILE_LEVELS = 6, 2
DATE = "2024-01-01T00:00:00Z"


def record(key: Column, url: Column, body: Column) -> Column:
    """A WARC/1.0 resource record as a string."""
    body, url = F.coalesce(body, F.lit("")), F.coalesce(url, F.lit(""))
    for c in ("\r", "\n"):
        url = F.replace(url, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"), key.cast("string"), F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit(f"\r\nWARC-Date: {DATE}\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def to_records(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """record_id long, record string."""
    k = F.coalesce(F.col(key).cast("long"), F.lit(-1))
    return pages.select(k.alias("record_id"), record(k, F.col(url), F.col(body)).alias("record"))


def write_files(records: DataFrame, path: str) -> None:
    """WARC files below ``path``: one folder for each file number, whose parts are in key order."""
    # the line end that the writer adds is the end of the record
    out = records.withColumn("file", F.shiftright("record_id", BITS * FILE_LEVELS)).selectExpr("file", "record_id", "left(record, length(record) - 2) AS value")
    out.repartition("file").sortWithinPartitions("file", "record_id").select("file", "value").write.partitionBy("file").option("lineSep", "\r\n").text(path)


def read_files(spark, path: str) -> DataFrame:
    """record_id, url, html, offset, length, record (the bytes as text) of every record of the files below ``path``.

    Bytes that are no record (a bad frame, a header cut off) come with a null id, up to the
    next record; ``record`` has all bytes of the file, one after the other.
    """
    import pandas as pd

    def one(raw: bytes, at: int) -> tuple:
        """Id, url, body and end of the record that starts at a place."""
        end = raw.index(b"\r\n\r\n", at)
        head = dict(x.split(b": ", 1) for x in raw[at:end].split(b"\r\n")[1:])
        stop = end + 4 + int(head[b"Content-Length"])
        if raw[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("no record ends here")
        return int(head[b"WARC-Record-ID"][12:-1]), head[b"WARC-Target-URI"].decode("utf-8", "replace"), raw[end + 4 : stop].decode("utf-8", "replace"), stop + 4

    def parse(frames):
        for frame in frames:
            rows = []
            for raw in frame["content"]:
                raw, at = bytes(raw), 0
                while at < len(raw):
                    try:
                        name, url, body, stop = one(raw, at)
                    except (ValueError, KeyError, IndexError):
                        again = raw.find(b"WARC/1.0\r\n", at + 1)
                        name, url, body, stop = None, None, None, again if again > 0 else len(raw)
                    rows.append((name, url, body, at, stop - at, raw[at:stop].decode("utf-8", "replace")))
                    at = stop
            yield pd.DataFrame(rows, columns=["record_id", "url", "html", "offset", "length", "record"]).astype({"record_id": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(parse, "record_id long, url string, html string, offset long, length long, record string")


def index(records: DataFrame) -> DataFrame:
    """file, record_id, offset, length, leaf of each key: byte ranges in the order of the keys."""
    one = records.select("record_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha"))
    many = one.groupBy("record_id", "sha").agg(F.sum("length").alias("length"), F.count("*").alias("n"))
    # equal rows are counted; different rows of a key are combined without regard to order
    part = lambda i: F.sum(F.conv(F.substring("sha", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") * F.col("n")).cast("string")
    leaf = many.groupBy("record_id").agg(F.sum("length").alias("length"), F.sum("n").alias("n"), F.min("sha").alias("sha"), F.concat_ws("-", *(part(i) for i in range(4))).alias("mixed"))
    leaf = leaf.select(F.shiftright("record_id", BITS * FILE_LEVELS).alias("file"), "record_id", "length", F.when(F.col("n") == 1, F.col("sha")).otherwise(F.sha2(F.concat_ws(" ", "n", "mixed"), 256)).alias("leaf"))
    before = F.sum("length").over(_in_file().rowsBetween(-(2 ** (BITS * FILE_LEVELS)), -1))
    return leaf.select("file", "record_id", F.coalesce(before, F.lit(0)).alias("offset"), "length", "leaf")


def _in_file():
    from pyspark.sql import Window

    return Window.partitionBy("file").orderBy("record_id")  # at most 4,096 keys


def tree(indexed: DataFrame, levels: int) -> list[DataFrame]:
    """Tables (node, length, hash), written, from the leaves up; after ``levels`` steps a root is left (two if there are negative keys)."""
    out = [indexed.select(F.col("record_id").alias("node"), "length", F.col("leaf").alias("hash"))]
    line = "concat_ws(' ', x.child, a.at, a.at + x.length, x.hash)"
    lines = f"aggregate(c, named_struct('at', 0L, 'text', ''), (a, x) -> named_struct('at', a.at + x.length, 'text', concat(a.text, {line}, '\n')))"
    for _ in range(levels):
        up = out[-1].groupBy(F.shiftright("node", BITS).alias("node")).agg(F.sort_array(F.collect_list(F.struct(F.col("node").alias("child"), "length", "hash"))).alias("c"))
        up = up.select("node", F.expr(lines).alias("l")).select("node", F.col("l.at").alias("length"), F.sha2("l.text", 256).alias("hash"))
        out.append(written(up, "nodes"))
    return out


def levels_for(*indexed: DataFrame) -> int:
    """Levels that a tree over the keys needs."""
    most = reduce(DataFrame.unionByName, (x.select("record_id") for x in indexed)).agg(F.max(F.abs("record_id"))).first()[0] or 0
    return max(FILE_LEVELS, -(-int(most).bit_length() // BITS))


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """record_id, left_leaf, right_leaf of the records in which two replicas differ; null: not there.

    ``left`` and ``right`` are what ``index`` returns, written.  Each level joins only
    the children of the nodes that differed one level above.
    """
    levels = levels_for(left, right)
    a, b = tree(left, levels), tree(right, levels)
    among = None
    for level in range(levels, -1, -1):
        x, y = (t[level].drop("length").withColumnRenamed("hash", n) for t, n in ((a, "left_leaf"), (b, "right_leaf")))
        if among is not None:
            x, y = (t.join(among, F.shiftright(t["node"], BITS) == among["parent"], "left_semi") for t in (x, y))
        differ = x.join(y, "node", "full_outer").where(~F.col("left_leaf").eqNullSafe(F.col("right_leaf")))
        if level:
            among = written(differ.select(F.col("node").alias("parent")), "branches")
    return differ.withColumnRenamed("node", "record_id")


def report(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every record of either replica: record_id, file, offset, length, sha256 (of the left, else the right), status."""
    left, right = written(index(left), "index"), written(index(right), "index")
    wrong = audit(left, right)
    extra = right.join(wrong.where("left_leaf IS NULL").select("record_id"), "record_id", "left_semi").withColumn("side", F.lit("extra"))
    every = left.withColumn("side", F.lit("left")).unionByName(extra).join(wrong, "record_id", "left")
    status = F.when(F.col("side") == "extra", "extra").when(F.col("left_leaf").isNull(), "ok").when(F.col("right_leaf").isNull(), "missing").otherwise("corrupt")
    return every.select("record_id", "file", "offset", "length", F.col("leaf").alias("sha256"), status.alias("status"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known faults: for keys 13 mod 97 the last byte is lost, keys 5 mod 211 are missing."""
    kept = pages.where("coalesce(page_id, -1) % 211 != 5")
    return kept.withColumn("html", F.expr("CASE WHEN page_id % 97 = 13 AND html != '' THEN left(html, length(html) - 1) ELSE html END"))


def query(pages: DataFrame) -> DataFrame:
    return report(to_records(pages), to_records(damaged(pages))).withColumnRenamed("record_id", "page_id")


ORACLE_SQL = f"""WITH p AS (SELECT coalesce(page_id, -1) AS page_id, replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') AS url, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, html, 'WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:' || page_id || '>\r\nWARC-Target-URI: ' || url
  || '\r\nWARC-Date: {DATE}\r\nContent-Type: text/html\r\nContent-Length: ' || strlen(html) || '\r\n\r\n' || html || '\r\n\r\n' AS record FROM p)
SELECT page_id, page_id >> {BITS * FILE_LEVELS} AS file, coalesce(sum(strlen(record)) OVER (PARTITION BY page_id >> {BITS * FILE_LEVELS} ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
  strlen(record) AS length, sha256(record) AS sha256, CASE WHEN page_id % 211 = 5 THEN 'missing' WHEN page_id % 97 = 13 AND html != '' THEN 'corrupt' ELSE 'ok' END AS status FROM r""".replace("\\r\\n", "' || chr(13) || chr(10) || '")
