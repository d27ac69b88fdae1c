"""Fuzzy deduplication of lines: MinHash of character shingles, exact Jaccard, components.

Lines (cut at ``\\n``) with a character other than white space take part; equal lines
are one.  A line's set: its distinct shingles of so many code points, by its length:

* short lines, of up to ``SHORT_TO`` code points: shingles of 5, linked if
  100 * |intersection| >= 65 * |union|.  A changed character leaves a line of 28 code
  points linked, a changed word of six letters one of 51;
* long lines, of ``LONG_FROM`` and more: shingles of 8, at 80 per cent.  Shorter shingles
  are shared by long lines that have nothing in common but their language.

Lines between the two limits are in both classes, and two lines are linked if they are by
either rule, so there is no border that a pair falls through: of two lines at 80 per
cent, one of them beyond ``SHORT_TO``, the other has at least ``LONG_FROM`` (unless it
repeats itself).  Lines of fewer than five code points are linked with equal lines
only.  Of each component the first line, by the smallest (document, line number), stays,
the others go.

Bands of four samples (long) and five (short: lines that share little more than their
language are many): a pair at the threshold is missed with probability
(1 - 0.8 ** 4) ** 20 = 2.7e-5 (long) or (1 - 0.65 ** 5) ** 64 = 3.7e-4 (short); at 0.9
and 0.75 with 2e-10 and 3.0e-8.  Candidates are confirmed on the full sets.  All further
work is on 64-bit line hashes; texts are read twice more, to confirm and to rewrite.

Defined results: blank lines stay; a document whose lines all go keeps an empty text; a
null text stays null; rows with a null key take no part and stay as they are; rows that
share a key are told apart by a hash of their text, and equal rows with one key stay
equal; ties in the place of a line go to the smallest key, then line number; keys may be
integers (in their order) or of any other type (in the order of a hash); long texts are
cut into their lines, of any length; other columns are carried along, whatever their
names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import discard, hash_strings, lean, mix, number_of, quoted, written
from tessitura.llm.linking import FEW, HOT, HOT_ROWS, ONE_IN, apart, bitmap, components, flagged, joined, link, packed
from tessitura.llm.minhash import bands, signatures

SHORT_TO, LONG_FROM = 130, 104
#: rule: code points in a shingle, per cent, bands, samples in a band
RULES = {"short": (5, 65, 64, 5), "long": (8, 80, 20, 4)}
_BLANK = r"^[\x20\x09-\x0D]*$"
_FACTORS = mix(np.arange(301, 305, dtype=np.uint64)) | np.uint64(1)
_OTHER = np.uint64(0x9E6C63D0876A9A47)


class Lines:
    """Distinct lines of a batch with their hashes; for each line in order, document, number and distinct line."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        parts = pc.split_pattern(texts, "\n")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = pc.list_flatten(parts).dictionary_encode()
        self.which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.lines = coded.dictionary
        self.blank = pc.match_substring_regex(self.lines, _BLANK).to_numpy(zero_copy_only=False)
        self.size = pc.utf8_length(self.lines).to_numpy(zero_copy_only=False).astype(np.int64)
        self.hash = hash_strings(self.lines).view(np.int64)
        self.counts = np.diff(offsets)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.number = np.arange(len(self.which)) - offsets[self.doc]

    def of(self, some: np.ndarray) -> pa.Array:
        return self.lines.take(pa.array(some))


def in_rule(rule: str, size: np.ndarray) -> np.ndarray:
    """Whether lines of ``size`` code points are in the class of ``rule``."""
    return (size >= RULES["short"][0]) & (size <= SHORT_TO) if rule == "short" else size >= LONG_FROM


def node(line: np.ndarray, size: np.ndarray, rule: str) -> np.ndarray:
    """Id of a line in the class of ``rule``: its hash, but for the long one of a line in both classes."""
    both = (size <= SHORT_TO) & (size >= LONG_FROM) & (rule == "long")
    return np.where(both, mix(line.view(np.uint64) ^ _OTHER).view(np.int64), line)


def windows(points: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` (5 or 8) code points from each place, but for the last ones."""
    h = points.astype(np.uint64)
    two = h[:-1] * _FACTORS[0] + h[1:]
    four = two[:-2] * _FACTORS[1] + two[2:]
    out = four[:-1] * _FACTORS[2] + h[4:] if width == 5 else four[:-4] * _FACTORS[3] + four[4:]
    return mix(out ^ np.uint64(width))


def shingles(lines: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes (repeats stay) of lines of at least ``width`` code points, and starts (one more than lines)."""
    size = pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = b"".join(lines.cast(pa.large_binary()).to_pylist()).decode().encode("utf-32-le")
    h = windows(np.frombuffer(raw, np.uint32), width)
    inside = np.ones(int(size.sum()), bool)
    ends = np.cumsum(size)
    for i in range(1, width):  # windows that would reach into the next line
        inside[ends - i] = False
    return h[inside[: len(h)]], np.concatenate(([0], np.cumsum(size - width + 1)))


def _blocks(sizes: np.ndarray, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    total, i = np.cumsum(sizes), 0
    while i < len(sizes):
        before = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, before + most, side="right")))
        yield i, j
        i = j


def _of_batch(texts: pa.Array) -> Iterator[tuple[int, int, Lines]]:
    for i, j in _blocks(np.array([v or 0 for v in pc.binary_length(texts).to_pylist()], np.int64)):
        yield i, j, Lines(texts.slice(i, j - i))


def placed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each line and class of a batch: line (hash), node, id and number of its first place in the batch, n (times there)."""

    def rows(x: Lines, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        # the first place: lines are in the order of the batch, ids may not be
        order = np.lexsort((x.number, ids[x.doc], x.which))
        first = order[np.append(True, x.which[order][1:] != x.which[order][:-1])]
        counts = np.bincount(x.which, minlength=len(x.lines)).astype(np.int64)
        long = in_rule("long", x.size)
        for rule, some in (("long", long), ("short", ~long | in_rule("short", x.size))):  # lines without a shingle are in neither, and counted with the short ones
            use = np.flatnonzero(~x.blank & some)
            at = first[use]
            yield pa.RecordBatch.from_arrays([pa.array(x.hash[use]), pa.array(node(x.hash[use], x.size[use], rule)), pa.array(ids[x.doc[at]]), pa.array(x.number[at].astype(np.int32)), pa.array(counts[use])], ["line", "node", "id", "number", "n"])

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for i, j, x in _of_batch(b.column(1)):
                if len(x.lines):
                    yield from rows(x, ids[i:j])

    return docs.select(number_of(docs, key).alias("id"), quoted(text)).where("id IS NOT NULL").mapInArrow(lean(run), "line long, node long, id long, number int, n long")


def banded(docs: DataFrame, key: str = "doc_id", text: str = "text", one_in: int = 1, parts: int = 0, hot: list[int] | None = None) -> DataFrame:
    """key and id (node) for each band of each line and class of a batch, or of one node in ``one_in`` by a hash; with ``parts`` as ``packed`` has them.

    The keys are many times as large as what they are made of, so they go into an exchange and no table.
    """

    def run(batches):
        for b in batches:
            for _, _, x in _of_batch(b.column(0)):
                for rule, (width, _, n_bands, samples) in RULES.items():
                    use = np.flatnonzero(~x.blank & in_rule(rule, x.size))
                    name = node(x.hash[use], x.size[use], rule)
                    if one_in > 1:
                        some = mix(name.view(np.uint64)) % np.uint64(one_in) == 0
                        use, name = use[some], name[some]
                    if len(use):
                        hashes, starts = shingles(x.of(use), width)
                        keys = bands(signatures(hashes, starts[:-1], samples * n_bands, seed=11), samples)
                        keys, ids = keys.view(np.int64).ravel(), np.repeat(name, n_bands)
                        yield packed(keys, ids, parts, hot or []) if parts else pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids)], ["key", "id"])

    return docs.where(number_of(docs, key).isNotNull()).select(quoted(text)).mapInArrow(lean(run), "part int, keys binary, ids binary" if parts else "key long, id long")


def shingle_set(raw: memoryview) -> tuple[np.ndarray, int]:
    """Sorted distinct shingles of a line, and the per cent to share; the first byte names the rule."""
    width, per_cent, *_ = list(RULES.values())[raw[0]]
    x = windows(np.frombuffer(bytes(raw[1:]).decode().encode("utf-32-le"), np.uint32), width)
    x.sort()
    return x[np.append(True, x[1:] != x[:-1])], per_cent


def lines_of(docs: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """id (node) and set (a byte for the rule, and the line: an eighth of its hashes) for the nodes of ``nodes`` (id)."""
    flags = bitmap(nodes, "id")

    def run(batches):
        sent = np.empty(0, np.int64)  # nodes of this task that have gone out, so that common lines go once
        for b in batches:
            for _, _, x in _of_batch(b.column(0)):
                for byte, rule in enumerate(RULES):
                    use = np.flatnonzero(~x.blank & in_rule(rule, x.size))
                    name = node(x.hash[use], x.size[use], rule)
                    there = flagged(flags, name) & ~np.isin(name, sent)
                    use, name = use[there], name[there]
                    if len(use):
                        sent = np.concatenate((sent, name))[-1_000_000:]
                        head = bytes([byte])
                        yield pa.RecordBatch.from_arrays([pa.array(name), pa.array([head + line for line in x.of(use).cast(pa.large_binary()).to_pylist()], pa.binary())], ["id", "set"])

    every = docs.select(quoted(text)).mapInArrow(lean(run), "id long, set binary")
    return every.join(nodes, "id", "left_semi").groupBy("id").agg(F.first("set").alias("set"))


def line_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """line (hash), n (times), keep_id and keep_number (where its class stays), for lines with company; written.

    Lines that occur once and are like no other have no row.
    """
    rows = written(placed(docs, key, text), "lines")
    scratch = [rows]
    found = link(lambda parts, hot: banded(docs, key, text, parts=parts, hot=hot), lambda ids: lines_of(docs, ids, text), shingle_set, scratch=scratch, sample=banded(docs, key, text, ONE_IN))
    # the two nodes of a line in both classes are one
    pairs = rows.where("node != line").select("line", F.col("node").alias("id")).join(found, "id", "left_semi").distinct()
    scratch.append(written(pairs, "bridges"))
    if not scratch[-1].isEmpty():
        bridges = scratch[-1].select(F.col("line").alias("a"), F.col("id").alias("b"))
        found = components(found.select(F.col("component").alias("a"), F.col("id").alias("b")).where("a != b").unionByName(bridges), scratch)
    linked = found.select(F.col("id").alias("line"), F.col("component").alias("class"))
    # a line in both classes has two rows for each of its places: count the one that has its own hash
    places = rows.where("node = line").groupBy("line").agg(F.min(F.struct("id", "number")).alias("first"), F.sum("n").alias("n"))
    places = places.join(linked, "line", "left").where("n > 1 OR class IS NOT NULL").select("line", F.coalesce("class", "line").alias("class"), "first", "n")
    places = written(places, "places")
    hot = [r[0] for r in places.groupBy("class").count().where(f"count >= {HOT_ROWS}").orderBy(F.desc("count"), "class").limit(HOT).collect()]
    best = places.groupBy("class").agg(F.min("first").alias("first"))
    out = joined(places.select("line", "class", "n"), best, ["class"], hot, "class")
    out = written(out.select("line", "n", F.col("first.id").alias("keep_id"), F.col("first.number").alias("keep_number")), "classes")
    discard(places, *scratch)
    return out


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, mark (hash of the text), numbers array<int>: the lines that go, for documents that lose any; written."""
    classes = line_classes(docs, key, text)
    flags = bitmap(classes, "line")
    hot = [r[0] for r in classes.where(f"n >= {HOT_ROWS}").orderBy(F.desc("n"), "line").limit(HOT).select("line").collect()]

    def run(batches):
        for b in batches:
            ids, marks = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, j, x in _of_batch(b.column(2)):
                use = np.flatnonzero((~x.blank & flagged(flags, x.hash))[x.which])
                doc = x.doc[use]
                yield pa.RecordBatch.from_arrays([pa.array(x.hash[x.which[use]]), pa.array(ids[i:j][doc]), pa.array(marks[i:j][doc]), pa.array(x.number[use].astype(np.int32))], ["line", "id", "mark", "number"])

    places = docs.select(number_of(docs, key).alias("id"), F.xxhash64(quoted(text)).alias("mark"), quoted(text)).where("id IS NOT NULL").mapInArrow(lean(run), "line long, id long, mark long, number int")
    gone = joined(places, classes, ["line"], hot, "line").where("id != keep_id OR number != keep_number")
    out = written(gone.groupBy("id", "mark").agg(F.sort_array(F.collect_set("number")).alias("numbers")), "gone")
    discard(classes)
    return out


def drop_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", removed: str = "n_lines_removed") -> DataFrame:
    """``docs`` with the lines that go left out of the text; ``removed`` (long) is added, in place of a column of that name.

    Up to ``FEW`` rows with the lines to lose are broadcast; beyond that, only rows that may be among them are dealt out with their texts.
    """
    gone = removed_lines(docs, key, text)
    name = F.xxhash64("id", "mark").alias("name")
    row = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), number_of(docs, key).alias("id"), F.xxhash64(quoted(text)).alias("mark"))
    size = gone.agg(F.count("*") + F.coalesce(F.sum(F.size("numbers")), F.lit(0)) / 8).first()[0]  # eight numbers take as much as a row
    if size <= FEW:
        out = row.join(F.broadcast(gone), ["id", "mark"], "left")
    else:
        some, others = apart(row.select("*", name), "name", gone.select(name))
        out = some.join(gone, ["id", "mark"], "left").select("row", "numbers").unionByName(others.select("row", F.lit(None).cast("array<int>").alias("numbers")))
    out = out.withColumn("lines", F.when(F.col("numbers").isNotNull(), F.split(F.col("row").getField(text), "\n")))
    out = out.withColumn("left", F.expr("array_except(sequence(0, size(lines) - 1), numbers)"))
    new = F.when(F.col("numbers").isNull(), F.col("row").getField(text)).otherwise(F.expr("array_join(transform(left, i -> lines[i]), '\n')"))
    columns = [(new if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns if c != removed]
    return out.select(*columns, F.when(F.col("numbers").isNull(), 0).otherwise(F.size("numbers")).cast("long").alias(removed))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines_removed, sha256 of the text that stays."""
    return drop_lines(docs).select("doc_id", "n_lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
