"""Byte-level BPE by speculation: propose greedily, verify in bulk, repair the few failures.

1. *Propose*: longest-match tokens for every distinct pre-token of a batch.
2. *Verify*: a sequence is the BPE encoding of its bytes if and only if every pair of
   neighbours is, so all pairs of the batch are looked up at once in a sorted table of
   known verdicts; a pair that is new is settled by merging its bytes exactly, once.
3. *Repair*: words with a bad pair are merged exactly by rank.

Any text gets exactly the ids of the reference vocabulary's own merge order.

Defined results: null texts count as empty; repeated rows and keys are encoded one by one
and alike; merges of equal rank go leftmost first; keys may be of any type; other columns
are ignored, whatever their names; an empty table gives an empty one; very long texts are
one piece each.  Memory: one Arrow batch of texts, and caches of
pre-tokens and verdicts that start anew at ``CACHE`` and four times as many entries.  The vocabulary file is a parameter and is
read where the work runs; it has a fixed size.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import lean

CACHE = 400_000
# White space as the Unicode property has it (the regex module's \s also takes \x1C to \x1F).
_S = "\t-\r \x85\xa0  -     　"
PRETOKENS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def byte_chars() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, and its byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_chars()
        raw = lambda s: bytes(chars[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(self.ids[raw(a)], self.ids[raw(b)]): (rank, self.ids[raw(a + b)]) for rank, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.ids))
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.own: dict[int, bool] = {}
        self.known, self.fits = np.empty(0, np.int64), np.empty(0, bool)
        self.words: dict[str, bytes] = {}
        self.split = regex.compile(PRETOKENS).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.repaired = 0

    # exact merging -------------------------------------------------------
    def merge(self, word: bytes) -> list[int]:
        """Merge by rank, lowest first and leftmost among equals; n log n."""
        ids = [self.single[b] for b in word]
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := self.ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := self.ranks.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (r[0], x, ids[x], ids[y], r[1]))
        return [x for x in ids if x >= 0]

    # speculation ---------------------------------------------------------
    def propose(self, word: bytes) -> list[int]:
        out, i, n, ids, longest = [], 0, len(word), self.ids, self.longest
        while i < n:
            j = min(n, i + longest)
            while (t := ids.get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """For each pair (a << 32 | b): is [a, b] the encoding of its bytes?"""
        distinct, back = np.unique(pairs, return_inverse=True)
        new = np.setdiff1d(distinct, self.known, assume_unique=True)
        if len(new):
            said = np.fromiter((self.merge(self.bytes_of[p >> 32] + self.bytes_of[p & 0xFFFFFFFF]) == [p >> 32, p & 0xFFFFFFFF] for p in new.tolist()), bool, len(new))
            known = np.concatenate((self.known, new))
            order = np.argsort(known, kind="stable")
            self.known, self.fits = known[order], np.concatenate((self.fits, said))[order]
        return self.fits[np.searchsorted(self.known, distinct)][back]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Encodings of pre-tokens."""
        out = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((t for x in out for t in x), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        inner = np.ones(len(flat), bool)
        inner[ends[sizes > 0] - 1] = False
        at = np.flatnonzero(inner)
        bad = at[~self.compatible(flat[at] << 32 | flat[at + 1])] if len(at) else at
        fail = set(np.searchsorted(ends, bad, side="right").tolist())
        for i in np.flatnonzero(sizes == 1).tolist():  # a token that its own merges don't reach
            t = out[i][0]
            if t not in self.own:
                self.own[t] = self.merge(self.bytes_of[t]) == [t]
            if not self.own[t]:
                fail.add(i)
        for i in fail:
            out[i] = self.merge(words[i])
        self.repaired += len(fail)
        return out

    # texts ---------------------------------------------------------------
    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.words) > CACHE:
            self.words.clear()
        if len(self.known) > 4 * CACHE:
            self.known, self.fits = self.known[:0], self.fits[:0]
        cut = [self.cut(t) if t and self.cut and any(s in t for s in self.special) else [t or ""] for t in texts]
        parts = [[p if i % 2 else self.split(p) for i, p in enumerate(x)] for x in cut]
        fresh = list({w for x in parts for p in x[::2] for w in p if w not in self.words})
        for w, ids in zip(fresh, self.encode_words([w.encode() for w in fresh]), strict=True):
            self.words[w] = np.array(ids, "<u4").tobytes()
        get = self.words.__getitem__
        out = []
        for x in parts:
            out.append(b"".join(self.special[p].to_bytes(4, "little") if i % 2 else b"".join(map(get, p)) for i, p in enumerate(x)))
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _chunks(texts: list, most: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` characters, so that memory doesn't follow the batch."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids array<int>."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        c = codec(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in _chunks(texts):
                ids = [np.frombuffer(x, "<i4") for x in c.encode_batch(texts[i:j])]
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(offsets, flat)], ["_key", "ids"])

    return docs.select(F.col(key).alias("_key"), text).mapInArrow(lean(run), f"_key {kind}, ids array<int>").withColumnRenamed("_key", key)


def decode(coded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """key and text, from key and ids; null ids give a null text."""
    kind = coded.schema[key].dataType.simpleString()

    def run(batches):
        c = codec(path)
        for b in batches:
            texts = [None if x is None else c.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["_key", "text"])

    return coded.select(F.col(key).alias("_key"), "ids").mapInArrow(lean(run), f"_key {kind}, text string").withColumnRenamed("_key", key)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256, same (decoded equals the text): encoded, then decoded from the ids."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        c = codec(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in _chunks(texts):
                ids = c.encode_batch(texts[i:j])
                back = [c.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, j - i), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x) for x in ids]),
                    pa.array([sha(x.encode()) for x in back]), pa.array([x == (t or "") for x, t in zip(back, texts[i:j], strict=True)]),
                ], ["_key", "n_tokens", "ids_sha256", "decoded_sha256", "same"])

    out = docs.select(F.col(key).alias("_key"), text).mapInArrow(lean(run), f"_key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean")
    return out.withColumnRenamed("_key", key)


def query(docs: DataFrame, path: str) -> DataFrame:
    return round_trip(docs, path).drop("same")
