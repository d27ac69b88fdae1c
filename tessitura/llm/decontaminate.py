"""Benchmark decontamination by spaced seeds.

Words are compared in lower case and without punctuation at their ends.  Each mask of ``MASKS`` picks the positions of a window
that are hashed; the others are ignored, so a window still hits where a word there was
changed.  A hit names a document, an item and a diagonal (document position less item
position).  Around it the two texts are laid side by side and the best run is taken
(+1 for an equal word, ``-MISS`` for a changed one).  A document is contaminated by an
item if its runs, on diagonals at most ``SHIFT`` apart (words put in or left out), hold
at least ``MIN_EQUAL`` equal words, or four fifths of a shorter item.

The penalty is as large as the gain, so a run goes on while more than half of its words
are equal.  Items no longer than a mask are also sought with any one word left out.
Benchmark items are the query set: they go to the tasks in slices of at most
``SLICE_BYTES`` of text, each checked before it is broadcast, one pass over the documents
for each slice, so a benchmark of any size works in bounded memory.  All documents are
searched, whole.

Defined results: items of fewer than ``MIN_ITEM`` words never match (they are too short to
tell a copy from chance), nor do null and empty texts and items; repeated items and
documents each report by their id; of equally good runs on a diagonal the longest counts,
and of equally good diagonals the one that starts first; very long texts are searched a
block at a time, with no cut inside a text; keys may be of any type; other columns are
ignored by ``contaminated`` and carried by ``drop_contaminated``, whatever their names; an
empty table of either kind gives no rows, or leaves all.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessitura.llm.common import Tokens, discard, hash_strings, lean, mix, quoted, written

MASKS = ("11011011", "11100111", "10110111", "11111000", "11010101", "10011011")
MIN_EQUAL, MIN_ITEM, MISS, SHIFT, SLICE_BYTES = 10, 5, 1, 4, 8_000_000
_ENDS = ".,;:!?\"'()[]{}*#$%&|<>"
_SPAN = len(MASKS[0])
_FACTORS = mix(np.arange(501, 501 + 16, dtype=np.uint64)) | np.uint64(1)
_FILTER_BITS = 22


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and where each text starts (one more than texts)."""
    t = Tokens(texts, lower=False)
    return hash_strings(pc.utf8_trim(pc.utf8_lower(t.words), _ENDS))[t.ids], t.starts


def window_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """One hash for each start of a window that lies inside ``h``."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    g = np.full(n, 1 + int(mask, 2), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            g += h[i : n + i] * _FACTORS[i]
    return mix(g)


def _masks(n: int) -> tuple[str, ...]:
    """Masks for an item of ``n`` words; of up to a mask's length, any one word may be changed."""
    one_out = tuple("1" * i + "0" + "1" * (n - i - 1) for i in range(n)) if n <= _SPAN else ()
    return (MASKS if n >= _SPAN else ()) + one_out


class Seeds:
    """Hashes of a slice of items, and their words for verification."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        h, starts = words_of(pa.array(texts, pa.string()))
        self.items = [(i, h[s:e]) for i, s, e in zip(ids, starts[:-1].tolist(), starts[1:].tolist(), strict=True) if e - s >= MIN_ITEM]
        self.masks, found = {}, {}
        for k, (_, w) in enumerate(self.items):
            for mask in _masks(len(w)):
                found.setdefault(mask, []).append((window_hashes(w, mask), k))
        for mask, x in found.items():
            hashes = np.concatenate([a for a, _ in x])
            item = np.concatenate([np.full(len(a), k) for a, k in x])
            at = np.concatenate([np.arange(len(a)) for a, _ in x])
            order = np.argsort(hashes, kind="stable")
            hashes, item, at = hashes[order], item[order], at[order]
            maybe = np.zeros(2**_FILTER_BITS, bool)
            maybe[(hashes & np.uint64(2**_FILTER_BITS - 1)).astype(np.int64)] = True
            self.masks[mask] = hashes, item, at, maybe

    def search(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(document number, item id, first word, words spanned, equal words) for each contamination."""
        h, starts = words_of(texts)
        ends = starts[1:]
        hits: set[tuple[int, int, int]] = set()
        for mask, (hashes, item, at, maybe) in self.masks.items():
            g = window_hashes(h, mask)
            p = np.flatnonzero(maybe[(g & np.uint64(2**_FILTER_BITS - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(hashes, g[p]), np.searchsorted(hashes, g[p], side="right")
            p, lo, hi = p[hi > lo], lo[hi > lo], hi[hi > lo]
            doc = np.searchsorted(ends, p, side="right")
            inside = p + len(mask) <= ends[doc] if len(p) else np.zeros(0, bool)
            p, lo, hi, doc = p[inside], lo[inside], hi[inside], doc[inside]
            n = hi - lo
            j = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
            diagonal = np.repeat(p - starts[doc], n) - at[j]
            hits.update(zip(np.repeat(doc, n).tolist(), item[j].tolist(), diagonal.tolist(), strict=True))
        runs: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
        for d, k, diagonal in hits:
            words, item = h[starts[d] : starts[d + 1]], self.items[k][1]
            a, b = max(0, diagonal), min(len(words), diagonal + len(item))
            equal = words[a:b] == item[a - diagonal : b - diagonal]
            total = np.concatenate(([0], np.cumsum(np.where(equal, 1, -MISS))))
            low = np.minimum.accumulate(total)
            e = len(total) - 1 - int(np.argmax((total - low)[::-1]))  # of equally good runs the longest
            s = int(np.argmax(total[: e + 1] == low[e]))
            if e > s:
                runs.setdefault((d, k), []).append((diagonal, a + s, a + e, int(equal[s:e].sum())))
        out = []
        for (d, k), x in runs.items():
            name, item = self.items[k]
            best = max(x, key=lambda r: (r[3], -r[1]))
            # runs on near diagonals count where they cover other words of the document
            chosen = []
            for r in sorted(x, key=lambda r: -r[3]):
                if abs(r[0] - best[0]) <= SHIFT and abs(r[1] - best[1]) <= 2 * len(item) and all(r[2] <= c[1] or r[1] >= c[2] for c in chosen):
                    chosen.append(r)
            same = sum(r[3] for r in chosen)
            if same >= min(MIN_EQUAL, -(-4 * len(item) // 5)):
                first, last = min(r[1] for r in chosen), max(r[2] for r in chosen)
                out.append((d, name, first, last - first, same))
        return out


def slices(benchmark: DataFrame, key: str, text: str, limit: int):
    """The items in parts whose text is at most ``limit`` bytes (or one item), read one part at a time."""
    ids, texts, size = [], [], 0
    for i, t in benchmark.select(key, text).where(F.col(text).isNotNull()).toLocalIterator():
        n = len(t.encode())
        if ids and size + n > limit:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(t)
        size += n
    if ids:
        yield ids, texts


def _hits(batch: pa.RecordBatch, column: int, seeds: Seeds):
    """(first row, contaminations) of runs of rows of some megabytes."""
    size = np.cumsum(np.array([v or 0 for v in pc.binary_length(batch.column(column)).to_pylist()], np.int64))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + 8_000_000, side="right")))
        yield i, seeds.search(batch.column(column).slice(i, j - i))
        i = j


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """key, item key, first_word, n_words (spanned), n_equal for each document and item that overlap."""
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType
    schema = f"_key {kind}, _item {item_kind.simpleString()}, first_word long, n_words long, n_equal long"
    context, item_type = docs.sparkSession.sparkContext, to_arrow_type(item_kind)
    found = [docs.sparkSession.createDataFrame([], schema)]
    for ids, texts in slices(benchmark, item_key, item_text, slice_bytes):
        seeds = context.broadcast(Seeds(ids, texts))  # of checked size

        def run(batches, seeds=seeds):
            for b in batches:
                for i, got in _hits(b, 1, seeds.value):
                    if got:
                        d, item, first, n, same = zip(*got, strict=True)
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i + x for x in d])), pa.array(item, item_type), *(pa.array(x, pa.int64()) for x in (first, n, same))], ["_key", "_item", "first_word", "n_words", "n_equal"])

        found.append(docs.select(F.col(quoted(key)).alias("_key"), quoted(text)).mapInArrow(lean(run), schema))
    out = reduce(DataFrame.unionByName, found)
    return out.withColumnRenamed("_key", key).withColumnRenamed("_item", item_key)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of ``docs`` that overlap no item.

    A slice is one pass that lets clean rows through, whole, so no text is shuffled; between
    slices the rows are written, so a task holds one slice at a time.
    """
    context, at, held = docs.sparkSession.sparkContext, docs.columns.index(text), None
    for n, (ids, texts) in enumerate(slices(benchmark, "item_id", "text", slice_bytes)):
        if n:
            done = written(docs, "clean")
            if held is not None:
                discard(held)
            docs = held = done
        seeds = context.broadcast(Seeds(ids, texts))  # of checked size

        def run(batches, seeds=seeds):
            for b in batches:
                bad = {i + hit[0] for i, got in _hits(b, at, seeds.value) for hit in got}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_())) if bad else b

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark)
