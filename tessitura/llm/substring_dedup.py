"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

A byte goes if a window of ``WINDOW`` bytes that covers it starts anywhere else too.
All suffixes are ordered by their first ``WINDOW`` bytes only, most significant digit
first, and suffixes alone in their group leave after each pass; the groups left after
the last pass are exactly the repeated windows.  The digits, from the most significant:

1. the window's own anchor: its ``ANCHOR``-byte substring with the smallest hash (the
   leftmost of equals), and in which of ``CELLS`` parts of the window it begins, with all
   bytes that the windows of such a cell have in common.  Some fifty neighbouring windows
   share them, so this pass sorts one row for a run of windows;
2. the run's whole context (all bytes of its windows).  Equal contexts are repeats in
   one go, and one of them stands for all of them from here on;
3. the window itself, only for runs whose anchor occurs in different contexts.

Equal windows have equal digits, so regrouping by digits in this order loses none.
Rows travel as packed arrays, dealt by the hash of the digit; a task keeps each distinct
digit once, with its first place, and streams the others past it, so a string that
occurs in a third of all documents costs no task more memory than one that occurs twice.

Digits are compared by 64-bit hashes.

Defined results: documents are told apart by key and text, so equal rows with an equal (or
null) key are one document, which doesn't repeat itself by being there twice; null texts
are empty; texts below ``WINDOW`` bytes lose nothing; long texts are cut into pieces that
overlap by ``WINDOW`` - 1 bytes; all copies of a string go, none is the first; keys may be
of any type; other columns are carried by ``with_spans``, whatever their names, and
ignored by ``query``; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import discard, mix, parts_for, quoted, written
from tessitura.llm.linking import bitmap, flagged

WINDOW, ANCHOR, CELLS, BLOCK = 400, 80, 3, 2_000_000
#: input of one part, and runs that a broadcast bitmap may point out for the last pass; beyond, they are joined
PART_BYTES, MOST_SPOTS = 16_000_000, 2**23
_G = 8  # bytes in one symbol
_POS_BITS = 23
_STEP = np.uint64(0xD1342543DE82EF95)


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    back = np.uint64(pow(int(_STEP), -1, 2**64))
    return np.cumprod(np.concatenate((one, np.full(n - 1, _STEP))), dtype=np.uint64), np.cumprod(np.concatenate((one, np.full(n - 1, back))), dtype=np.uint64)


class Block:
    """Runs of windows of some pieces of text: document, first and last window start, anchor and context hashes."""

    def __init__(self, pieces: list[tuple[int, int, bytes]], window: int = WINDOW, anchor: int = ANCHOR):
        self.window = window
        sizes = np.array([len(p[2]) for p in pieces], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.ids, self.bases = np.array([p[0] for p in pieces], np.int64), np.array([p[1] for p in pieces], np.int64)
        n = int(self.starts[-1])
        raw = b"".join(p[2] for p in pieces) + bytes(window + 2 * _G)
        m = n + window
        power, back = _powers(max(m, BLOCK + 8 * window))
        self.back = back
        self.sums = np.empty(m + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(mix(np.ndarray((m,), "<u8", buffer=raw, strides=(1,))) * power[:m], dtype=np.uint64, out=self.sums[1:])
        wide = window - anchor + 1
        if n < window:
            valid = np.empty(0, np.int64)
        else:
            order = mix(self.hash(np.arange(n), anchor))
            key = np.full(-(-n // wide) * wide, np.uint64(2**64 - 1))
            key[:n] = order >> np.uint64(_POS_BITS) << np.uint64(_POS_BITS) | np.arange(n, dtype=np.uint64)
            rows = key.reshape(-1, wide)
            ahead = np.minimum.accumulate(rows, axis=1).ravel()
            behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
            at = (np.minimum(behind[: n - wide + 1], ahead[wide - 1 : n]) & np.uint64(2**_POS_BITS - 1)).astype(np.int64)
            inside = np.zeros(n + 1, np.int32)
            long = sizes >= window
            np.add.at(inside, self.starts[:-1][long], 1)
            np.add.at(inside, self.starts[1:][long] - window + 1, -1)
            valid = np.flatnonzero(np.cumsum(inside[:n]) > 0)
        if len(valid):
            a = at[valid]
            cut = np.append(True, (a[1:] != a[:-1]) | (valid[1:] != valid[:-1] + 1))
            i = np.flatnonzero(cut)
            self._cells(a[i], valid[i], valid[np.append(i[1:] - 1, len(valid) - 1)], -(-wide // CELLS))
        else:
            self.low = self.high = np.empty(0, np.int64)
            self.anchors = self.contexts = np.empty(0, np.uint64)
        piece = np.searchsorted(self.starts, self.low, side="right") - 1
        self.doc, self.shift = self.ids[piece], self.bases[piece] - self.starts[piece]

    def _cells(self, a: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> None:
        """Runs of anchors ``a`` and window starts low to high, cut where the anchor's place in the window leaves a cell."""
        first, last = (a - high) // width, (a - low) // width
        n = last - first + 1
        a, low, high = (np.repeat(x, n) for x in (a, low, high))
        cell = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(len(a))
        self.low, self.high = np.maximum(low, a - cell * width - width + 1), np.minimum(high, a - cell * width)
        core = self.hash(a - cell * width, self.window - width + 1)
        self.anchors = mix(core ^ mix(cell.astype(np.uint64)))
        self.contexts = mix(self.hash(self.low, self.high - self.low + self.window) ^ mix(((a - self.low) * 1024 + (self.high - self.low)).astype(np.uint64)))

    def hash(self, at: np.ndarray, length) -> np.ndarray:
        """Hash of ``length`` bytes from each place."""
        return (self.sums[at + (length - _G + 1)] - self.sums[at]) * self.back[at]


def _pieces(ids: list, texts: list, window: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Blocks of about ``BLOCK`` bytes; longer texts in overlapping pieces."""
    out, size = [], 0
    for i, t in zip(ids, texts, strict=True):
        raw = (t or "").encode()
        if len(raw) < window:
            continue
        for base in range(0, len(raw) - window + 1, BLOCK):
            piece = raw[base : base + BLOCK + window - 1]
            if out and size + len(piece) > BLOCK:
                yield out
                out, size = [], 0
            out.append((i, base, piece))
            size += len(piece)
    if out:
        yield out


def _spot(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of a place in a document."""
    return mix(doc.view(np.uint64) ^ mix(at.astype(np.uint64)))


def _dealt(part: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple]:
    """part and the rows of each array for it, as bytes."""
    order = np.argsort(part, kind="stable")
    p = part[order]
    cut = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else np.empty(0, np.int64)
    arrays = [a[order] for a in arrays]
    for s, e in zip(cut, np.append(cut[1:], len(p)), strict=True):
        yield (int(p[s]), *(a[s:e].tobytes() for a in arrays))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names)


class Seen:
    """Distinct digits with the row of their first place; digests come in batches."""

    def __init__(self, width: int):
        self.keys, self.rows, self.multi = np.empty(0, np.uint64), np.empty((0, width), np.int64), np.empty(0, bool)

    def add(self, keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Rows now known to share their key with another: of this batch, and first places once."""
        order = np.argsort(keys, kind="stable")
        keys, rows = keys[order], rows[order]
        first = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.empty(0, bool)
        group = np.cumsum(first) - 1
        own = keys[first]
        count = np.bincount(group, minlength=len(own))
        at = np.searchsorted(self.keys, own)
        old = np.zeros(len(own), bool)
        inner = at < len(self.keys)
        old[inner] = self.keys[at[inner]] == own[inner]
        late = at[old & ~self.multi[np.minimum(at, max(len(self.multi) - 1, 0))]] if len(self.keys) else at[:0]
        out = np.concatenate((self.rows[late], rows[(old | (count > 1))[group]]))
        self.multi[late] = True
        new = ~old
        both = np.concatenate((self.keys, own[new]))
        order = np.argsort(both, kind="stable")
        self.keys = both[order]
        self.rows = np.concatenate((self.rows, rows[first][new]))[order]
        self.multi = np.concatenate((self.multi, (count > 1)[new]))[order]
        return out


def _gathered(batches, dtypes: list[str], least: int = 1_000_000) -> Iterator[list[np.ndarray]]:
    """Packed columns (after the part) as arrays of at least ``least`` rows, but for the last."""
    held, n = [], 0
    for b in batches:
        x = [np.frombuffer(b"".join(b.column(i + 1).to_pylist()), t) for i, t in enumerate(dtypes)]
        held.append(x)
        n += len(x[0])
        if n >= least:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def repeated_spans(docs: DataFrame, text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """_doc (hash of id and text) and starts, ends array<int>: maximal runs of bytes to remove."""
    spark = docs.sparkSession
    parts = parts_for(docs, PART_BYTES)

    def runs(batches):
        for b in batches:
            for pieces in _pieces(b.column(0).to_pylist(), b.column(1).to_pylist(), window):
                x = Block(pieces, window, anchor)
                low = x.low + x.shift
                yield _batch(list(_dealt((x.anchors % np.uint64(parts)).astype(np.int32), [x.anchors, x.contexts, x.doc, low, (x.high - x.low).astype(np.int32)])), ["part", "a", "c", "d", "p", "n"])

    def by_context(batches):
        seen = Seen(4)
        for a, c, d, p, n in _gathered(batches, ["<u8", "<u8", "<i8", "<i8", "<i4"], 400_000):
            got = seen.add(mix(c ^ mix(a)), np.stack((a.view(np.int64), d, p, n.astype(np.int64)), axis=1))
            yield from _places(got[:, 1], got[:, 2], got[:, 3], 1)
        own = seen.rows[:, 0]
        _, back, count = np.unique(own, return_inverse=True, return_counts=True)
        left = seen.rows[count[back] > 1]
        yield from _places(left[:, 1], left[:, 2], left[:, 3], 2)

    def _places(d, p, n, pass_no):
        for i in range(0, len(d), 500_000):
            s = slice(i, i + 500_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d[s]), pass_no, np.int32)), pa.array(d[s]), pa.array(p[s]), pa.array(n[s])], ["pass", "doc", "low", "n"])

    source = docs.select("_doc", F.col(text).alias("_text"))
    blobs = "part int, a binary, c binary, d binary, p binary, n binary"
    first = source.mapInArrow(runs, blobs).repartition(parts, "part").mapInArrow(by_context, "pass int, doc long, low long, n long")
    first = written(first, "runs")
    done = first.where("pass = 1").select("doc", "low", "n")

    def spots(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_spot(b.column(0).to_numpy(), b.column(1).to_numpy()).view(np.int64))], ["spot"])

    left = first.where("pass = 2").select("doc", "low")
    count = left.count()
    few = count <= MOST_SPOTS
    flags = None
    if few:
        table = written(left.mapInArrow(spots, "spot long"), "spots")
        flags = spark.sparkContext.broadcast(bitmap(table, "spot", max(20, int(16 * count).bit_length())))  # 16 bits a run, at most 16 MB
        discard(table)

    def windows(batches):
        for b in batches:
            lows = [None] * b.num_rows if few else b.column(2).to_pylist()
            wanted = {d: np.array(x, np.int64) for d, x in zip(b.column(0).to_pylist(), lows, strict=True) if x is not None}
            for pieces in _pieces(b.column(0).to_pylist(), b.column(1).to_pylist(), window):
                x = Block(pieces, window, anchor)
                place = x.low + x.shift
                if few:
                    use = np.flatnonzero(flagged(flags.value, _spot(x.doc, place).view(np.int64)))
                else:
                    use = np.concatenate([np.flatnonzero((x.doc == d) & np.isin(place, wanted[d])) for d in dict.fromkeys(p[0] for p in pieces)])
                if not len(use):
                    continue
                n = x.high[use] - x.low[use] + 1
                at = np.repeat(x.low[use] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                h = mix(x.hash(at, window))
                place = at + np.repeat(x.shift[use], n)
                yield _batch(list(_dealt(((h >> np.uint64(20)) % np.uint64(parts)).astype(np.int32), [h, np.repeat(x.doc[use], n), place.astype(np.int32)])), ["part", "h", "d", "p"])

    def by_window(batches):
        seen = Seen(2)
        for h, d, p in _gathered(batches, ["<u8", "<i8", "<i4"]):
            got = seen.add(h, np.stack((d, p.astype(np.int64)), axis=1))
            yield _batch(list(_dealt((mix(got[:, 0].view(np.uint64)) % np.uint64(parts)).astype(np.int32), [got[:, 0], got[:, 1].astype(np.int32), np.zeros(len(got), np.int32)])), ["part", "d", "p", "n"])

    def packed(batches):
        for b in batches:
            d, p, n = (b.column(i).to_numpy() for i in range(3))
            yield _batch(list(_dealt((mix(d.view(np.uint64)) % np.uint64(parts)).astype(np.int32), [d, p.astype(np.int32), n.astype(np.int32)])), ["part", "d", "p", "n"])

    def spans(batches):
        got = list(_gathered(batches, ["<i8", "<i4", "<i4"], 1 << 62))
        if not got:
            return
        d, p, n = got[0]
        order = np.lexsort((p, d))
        d, s, e = d[order], p[order].astype(np.int64), p[order].astype(np.int64) + n[order] + window
        # the farthest end so far within the document
        doc = np.cumsum(np.append(True, d[1:] != d[:-1]))
        far = np.maximum.accumulate(e + (doc << 36)) - (doc << 36)
        cut = np.append(True, (doc[1:] != doc[:-1]) | (s[1:] > far[:-1]))
        i = np.flatnonzero(cut)
        owner, starts, ends = d[i], s[i], far[np.append(i[1:] - 1, len(d) - 1)]
        j = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        offsets = np.append(j, len(owner)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(owner[j]), pa.ListArray.from_arrays(offsets, pa.array(starts.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(ends.astype(np.int32)))], ["_doc", "starts", "ends"])

    blobs = "part int, d binary, p binary, n binary"
    if not few:  # only documents that have such runs, with the runs' places
        source = source.join(left.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list("low").alias("_lows")), "_doc").select("_doc", "_text", "_lows")
    last = source.mapInArrow(windows, "part int, h binary, d binary, p binary").repartition(parts, "part").mapInArrow(by_window, blobs)
    every = last.unionByName(done.mapInArrow(packed, blobs))
    return every.repartition(parts, "part").mapInArrow(spans, "_doc long, starts array<int>, ends array<int>")


def with_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` and starts, ends array<int> of the byte runs to remove (null: none), in place of columns of these names."""
    rows = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), F.col(quoted(text)).alias("text"), F.xxhash64(quoted(key), quoted(text)).alias("_doc"))
    out = rows.join(written(repeated_spans(rows, "text", window, anchor), "spans"), "_doc", "left")
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("starts", "ends")), "starts", "ends")


def cut(raw: bytes, starts, ends) -> bytes:
    """``raw`` without its spans."""
    out, at = [], 0
    for s, e in zip(starts, ends, strict=True):
        out.append(raw[at:s])
        at = e
    out.append(raw[at:])
    return b"".join(out)


def query(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    def digest(batches):
        for b in batches:
            rows = []
            for t, s, e in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                raw = (t or "").encode()
                left = cut(raw, s or (), e or ())
                rows.append((len(raw), len(raw) - len(left), len(s or ()), hashlib.sha256(left).hexdigest()))
            n, gone, spans, sha = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, spans)), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = with_spans(docs.select("doc_id", "text"), "doc_id", "text", window, anchor)
    return out.select("doc_id", "text", "starts", "ends").mapInArrow(digest, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
