"""Near-duplicate documents: MinHash bands find candidates, odd sketches thin them, full sets decide.

A document's set: its distinct 5-word shingles (words lower-cased in A-Z only); with
fewer words, the whole sequence as one shingle; without words, empty, linked with
nothing.  Two documents are linked if 100 * |intersection| >= 75 * |union|.

* Documents with equal sets are one representative (the smallest id) from the start.
* ``BANDS`` bands of ``ROWS`` samples: a pair at the threshold misses every band with
  probability (1 - 0.75 ** 4) ** 40 = 2.5e-7, more similar pairs with less.
* An odd sketch is the parity bitmap of the samples; the population count of the XOR of
  two estimates their share of equal samples.  Candidates estimated below
  ``SKETCH_FLOOR`` are dropped: at the threshold that is some six standard deviations off.
* All others are confirmed on the full sets, read again from the texts.

``linking`` tests stars, then shares of rare shingles, never all pairs of a group, and
splits hot buckets.  Shingles are compared by 64-bit hashes.

Defined results: null and empty texts have no shingles and are linked with nothing; a
null key is linked with nothing and has a null component; rows with equal keys are one
document, for which the largest of their sets stands, and each row is reported; ties (equal
sets) go to the smallest key; keys may be of any type that can be ordered; very long
texts are taken whole, some at a time; other columns are ignored by ``near_duplicates``
and carried by ``keep_first``, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import Tokens, discard, hash_strings, lean, mix, number_of, quoted, written
from tessitura.llm.linking import FEW, HOT, HOT_ROWS, apart, as_hashes, bitmap, flagged, joined, link
from tessitura.llm.minhash import bands, odd_similarity, odd_sketches, signatures

WORDS, PER_CENT = 5, 75
ROWS, BANDS, SKETCH_BITS, SKETCH_FLOOR = 4, 40, 512, 0.4
#: ids that a broadcast bitmap may point out
MOST_FLAGGED = 2**23
_FACTORS = mix(np.arange(101, 101 + 64, dtype=np.uint64)) | np.uint64(1)


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents, sorted within each, and starts (one more than documents)."""
    t = Tokens(texts)
    h = hash_strings(t.words)[t.ids]
    n = t.lengths
    if len(h) >= words:
        g = h[: len(h) - words + 1] * _FACTORS[0]
        for i in range(1, words):
            g += h[i : len(h) - words + 1 + i] * _FACTORS[i]
        g = mix(g)
    else:
        g = np.empty(0, np.uint64)
    parts, sizes = [], np.zeros(len(n), np.int64)
    for i, (s, m) in enumerate(zip(t.starts[:-1].tolist(), n.tolist(), strict=True)):
        if m >= words:
            p = g[s : s + m - words + 1].copy()
            p.sort()
            p = p[np.append(True, p[1:] != p[:-1])]
        elif m:
            p = mix((h[s : s + m] * _FACTORS[8 : 8 + m]).sum(keepdims=True) + np.uint64(m))
        else:
            continue
        parts.append(p)
        sizes[i] = len(p)
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), np.concatenate(([0], np.cumsum(sizes)))


def _slices(texts: pa.Array, most: int = 4_000_000):
    """Runs of documents of about ``most`` bytes."""
    size = np.cumsum(np.array([0 if v is None else v for v in pa.compute.binary_length(texts).to_pylist()], np.int64))
    i, n = 0, len(texts)
    while i < n:
        before = size[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(size, before + most, side="right")))
        yield i, min(j, n)
        i = j


def sketch(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, print_a and print_b (equal for equal sets), bands array<long>, sketch binary."""

    def run(batches):
        for b in batches:
            for i, j in _slices(b.column(1)):
                hashes, starts = shingles(b.column(1).slice(i, j - i))
                n = np.diff(starts)
                full = np.flatnonzero(n)
                sig = signatures(hashes, starts[:-1][full], ROWS * BANDS)
                prints = np.zeros((2, len(n)), np.uint64)
                for p in (0, 1):
                    if len(full):
                        prints[p, full] = np.add.reduceat(mix(hashes + np.uint64(p + 1)), starts[:-1][full])
                some = bands(sig, ROWS).astype(np.int64) if len(full) else np.empty((0, BANDS), np.int64)
                offsets = np.concatenate(([0], np.cumsum(np.where(n > 0, BANDS, 0)))).astype(np.int32)
                odd = iter(odd_sketches(sig, SKETCH_BITS) if len(full) else ())
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, j - i), pa.array(n), *(pa.array(p.view(np.int64)) for p in prints),
                    pa.ListArray.from_arrays(offsets, pa.array(some.ravel())), pa.array([next(odd).tobytes() if m else None for m in n], pa.binary()),
                ], ["id", "n_shingles", "print_a", "print_b", "bands", "sketch"])

    return docs.select(number_of(docs, key).alias("id"), quoted(text)).mapInArrow(lean(run), "id long, n_shingles long, print_a long, print_b long, bands array<long>, sketch binary")


def sets_of(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """id and set (sorted distinct hashes as a binary) for the documents of ``ids``."""
    rows = docs.select(number_of(docs, key).alias("id"), quoted(text)).where("id IS NOT NULL")
    count = ids.count()
    flags = bitmap(ids, "id", max(20, int(16 * count).bit_length())) if count <= MOST_FLAGGED else None  # 16 bits an id, at most 16 MB
    if flags is None:  # texts meet their ids first
        rows = rows.join(ids, "id", "left_semi")

    def run(batches):
        for b in batches:
            if flags is not None:
                b = b.filter(pa.array(flagged(flags, b.column(0).to_numpy())))
            for i, j in _slices(b.column(1)):
                hashes, starts = shingles(b.column(1).slice(i, j - i))
                spans = [slice(s, e) for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                prints = np.array([mix(hashes[x] + np.uint64(1)).sum(dtype=np.uint64) for x in spans], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([hashes[x].tobytes() for x in spans], pa.binary()), pa.array(prints)], ["id", "set", "print"])

    every = rows.mapInArrow(lean(run), "id long, set binary, print long")
    return every.join(ids, "id", "left_semi").groupBy("id").agg(F.max_by("set", F.struct(F.octet_length("set"), "print")).alias("set"))


def sketched_alike(pairs: DataFrame, sketches: DataFrame, per_cent: int = PER_CENT, floor: float = SKETCH_FLOOR) -> DataFrame:
    """Pairs (a, b) whose sizes allow the threshold and whose odd sketches don't rule it out."""

    def run(batches):
        for x in batches:
            a, b = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH_BITS // 8) for c in (2, 3))
            keep = pa.array(odd_similarity(a, b, ROWS * BANDS) >= floor)
            yield pa.RecordBatch.from_arrays([x.column(0).filter(keep), x.column(1).filter(keep)], ["a", "b"])

    one, two = (sketches.select(F.col("id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}")) for k in "ab")
    near = pairs.join(one, "a").join(two, "b").where(f"100 * least(n_a, n_b) >= {per_cent} * greatest(n_a, n_b)")
    return near.select("a", "b", "s_a", "s_b").mapInArrow(lean(run), "a long, b long")


def _classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, n_shingles and component (both internal numbers) of every row with an id."""
    every = written(sketch(docs, key, text), "sketches")
    same = ["print_a", "print_b", "n_shingles"]
    known = every.where("id IS NOT NULL")
    # rows with one id: the largest set stands for all of them
    again = known.groupBy("id").agg(F.count("*").alias("rows"), F.max(F.struct("n_shingles", "print_a", "print_b")).alias("s")).where("rows > 1").select("id", *(F.col(f"s.{c}").alias(f"of_{c}") for c in same))
    if not again.isEmpty():
        known = known.join(again, "id", "left").where("of_n_shingles IS NULL OR n_shingles = of_n_shingles AND print_a = of_print_a AND print_b = of_print_b").drop(*(f"of_{c}" for c in same)).dropDuplicates(["id"])
    copies = written(known.where("n_shingles > 0").groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "copies")
    hot = [r[0] for r in copies.where(f"n >= {HOT_ROWS}").orderBy(F.desc("n"), "print_a").limit(HOT).select("print_a").collect()]
    twins = written(joined(known.select("id", *same), copies.drop("n"), same, hot, "print_a").select("id", "rep"), "twins")
    lone = known.where("n_shingles > 0").join(twins.where("id != rep").select("id"), "id", "left_anti")
    lone = written(lone.select("id", "n_shingles", "bands", "sketch"), "representatives")
    sketches = lone.select("id", "n_shingles", "sketch")

    scratch: list[DataFrame] = []
    found = link(
        lone.select(F.explode("bands").alias("key"), "id"),
        lambda ids: sets_of(docs, ids, key, text),
        as_hashes(PER_CENT),
        lambda pairs: sketched_alike(pairs, sketches),
        scratch=scratch,
    )
    # a new component for each id that has one of others: ids are distinct here, so no key is hot
    few = found.withColumnRenamed("id", "rep")
    heads = copies.where(F.col("rep").isNotNull()).join(few, "rep", "left").select(*same, F.coalesce("component", "rep").alias("component"))
    of_twins = joined(known.select("id", *same), heads, same, hot, "print_a").select("id", "component")
    names = of_twins.unionByName(found.join(twins.select("id"), "id", "left_anti"))
    out = every.select("id", "n_shingles").join(names, "id", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component"))
    out = written(out, "classes")
    discard(every, copies, twins, lone, *scratch)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (the smallest key of the component), kept for every row.

    Integer keys become long; keys of other types stay as they are.
    """
    out = _classes(docs, key, text)
    if docs.schema[key].dataType.typeName() in ("long", "integer", "short", "byte"):
        out = out.select(F.col("id").alias(key), "n_shingles", F.col("component").alias("component_id"))
    else:
        names = docs.select(F.col(quoted(key)).alias("_key"), number_of(docs, key).alias("id")).where("id IS NOT NULL").distinct()
        out = out.join(names, "id", "left")
        first = out.groupBy("component").agg(F.min("_key").alias("component_id"))
        out = out.join(first, "component", "left").select(F.col("_key").alias(key), "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col(quoted(key)) == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document is the first of its component; rows with a null key stay.

    Up to ``FEW`` keys that go are broadcast; beyond that, only rows that may have one are dealt out with their texts.
    """
    gone = written(near_duplicates(docs, key, text).where("NOT kept").select(F.col(quoted(key)).alias("key")).distinct(), "gone")
    rows = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), number_of(docs, key).alias("id"))
    some, others = (rows, None) if (few := gone.count() <= FEW) else apart(rows, "id", gone.select(number_of(gone, "key")))
    out = some.join(F.broadcast(gone) if few else gone, F.col("row").getField(key) == F.col("key"), "left_anti")
    return (out if few else out.unionByName(others)).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
