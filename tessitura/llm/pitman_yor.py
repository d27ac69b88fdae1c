"""A hierarchical Pitman-Yor bigram model, sampled in shards.

Each context word has a restaurant whose customers are the words that follow it; each of
its tables sends one customer to the parent restaurant (unigrams), whose own tables draw
from a uniform base over the vocabulary and one unknown word.  Given a seating

    P(w | u) = (c_uw - D t_uw + (S + D t_u) P(w)) / (S + c_u),   P(w) alike over tables.

Seatings are sampled by Gibbs, in blocks that are independent given the rest, so that a
sweep reseats every customer, of every dish, however large:

* the parent's measure given its seating: gamma variables of c_w - D t_w;
* for each restaurant an auxiliary gamma variable v of shape S / D + (its tables); given
  v and the measure, the tables of its dishes are independent, with odds
  (D v P(w)) ** t S(c, t) in generalised Stirling numbers (``seating``);
* the parent's own tables alike, from the uniform base.

The corpus is never in one place.  Contexts are dealt to shards by hash; a shard samples
its restaurants together with a parent of their own (an unbiased picture of the whole,
for contexts are dealt at random) and sends the tables of each of ``SAMPLES`` sweeps up.
For each of them the one true parent, dealt by word, is sampled from the tables of all
shards, so leaves and parent of a sample belong together, and the predictive probability
is averaged over samples.  Very frequent contexts are dealt to several shards by the next
word; their table counts add up.  Shards grow in number with the tokens, not in size.

Blocks of documents hold token numbers and their dictionary.  They ask the shards for
their distinct bigrams and words, packed in arrays, and get the answers back in the same
order; nothing of the model is broadcast, and every exchange grows with the corpus.

Words are lower-cased in A-Z; each text ends in one end token, which is also the context
of its first word.  Null texts are empty.  Words are told apart by 64-bit
hashes for the counts, and by 48 bits of them for the model.
Repeated rows are scored one by one, with equal scores; keys may be of any type; a null
key counts as training; other columns are ignored, whatever their names; longer texts
than a block are a block of their own; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessitura.llm.common import Tokens, discard, hash_strings, mix, quoted, written
from tessitura.llm.seating import tables

BLOCK, SHARD_TOKENS = 12_000_000, 8_000_000
#: discounts and strengths of contexts and parent
D_LEAF, S_LEAF, D_ROOT, S_ROOT = 0.7, 0.1, 0.85, 10.0
BURN_IN, SAMPLES = 5, 3
_END = np.uint64(0xE2D0E2D0E2D0E2D1)
_SHORT = np.uint64(2**48 - 1)


def short(words: np.ndarray) -> bytes:
    """The low 48 bits of word hashes, packed: enough to tell the words of the model apart."""
    return np.ascontiguousarray(words.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def long(raw: bytes) -> np.ndarray:
    """48-bit hashes as integers."""
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def pack(x: np.ndarray) -> bytes:
    """Small integers, their bytes by place and compressed."""
    return pa.compress(np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def unpack(raw: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(pa.decompress(raw, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(x.T).view("<i4").ravel().astype(np.int64)


def distinct_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and the number of each place's, as np.unique has them, in about half of its memory."""
    order = np.argsort(x, kind="stable")
    ordered = x[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(x)]
    out = ordered[new]
    del ordered
    back = np.empty(len(x), np.int32)
    number = np.cumsum(new, dtype=np.int32)
    number -= 1
    back[order] = number
    return out, back


def sample_root(c: np.ndarray, base: float, share: float, rng: np.random.Generator, t: np.ndarray | None = None, sweeps: int = BURN_IN) -> np.ndarray:
    """Tables of the parent's dishes; ``share``: how much of the parent this is."""
    t = np.ones(len(c), np.int64) if t is None else t
    for _ in range(sweeps if len(c) else 0):
        v = rng.gamma(S_ROOT / D_ROOT + t.sum() / share)
        t = tables(c, np.full(len(c), D_ROOT * v * base), D_ROOT, rng)
    return t


def sample_shard(c: np.ndarray, home: np.ndarray, dish: np.ndarray, spread: np.ndarray, seed: int, samples: int = SAMPLES) -> np.ndarray:
    """Tables of (home, dish) rows with ``c`` customers, one row for each sample, with a parent of their own.

    ``spread``: over how many shards the restaurant of each home is dealt.
    """
    out = np.zeros((samples, len(c)), np.int32)
    if not len(c):
        return out
    rng = np.random.default_rng(seed)
    _, dish = distinct_of(dish)
    homes, dishes = len(spread), int(dish.max()) + 1
    base = 1 / (dishes + 1)
    t, root = np.ones(len(c), np.int64), np.ones(dishes, np.int64)
    for i in range(BURN_IN + samples):
        up = np.bincount(dish, t, dishes).astype(np.int64)
        root = sample_root(up, base, 1.0, rng, np.minimum(root, up), 1)
        mass, rest = rng.gamma(up - D_ROOT * root), rng.gamma(S_ROOT + D_ROOT * root.sum())
        measure = (mass + rest * base) / (mass.sum() + rest)
        v = rng.gamma(S_LEAF / D_LEAF + spread * np.bincount(home, t, homes))
        t = tables(c, D_LEAF * v[home] * measure[dish], D_LEAF, rng)
        if i >= BURN_IN:
            out[i - BURN_IN] = t
    return out


# blocks ------------------------------------------------------------------
def tokenized(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks: block, docs array<long>, held array<boolean>, sizes, ids (numbers by falling frequency), words, heavy."""

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def block():
            x = pa.Table.from_batches(held)
            t = Tokens(x.column(2))
            ends = t.starts[1:] + np.arange(len(t.starts) - 1)
            ids = np.full(len(t.ids) + len(ends), len(t.words), np.int64)
            inner = np.ones(len(ids), bool)
            inner[ends] = False
            ids[inner] = t.ids
            words = np.append(hash_strings(t.words), _END)
            order = np.argsort(-np.bincount(ids, minlength=len(words)), kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            return pa.RecordBatch.from_arrays([
                pa.array([part * 1_000_000 + n]), pa.array([len(ids)]), pa.array([x.column(0).to_pylist()], pa.list_(x.column(0).type)), pa.array([x.column(1).to_pylist()], pa.list_(pa.bool_())),
                pa.array([np.diff(ends, prepend=-1).astype(np.int32).tobytes()]), pa.array([pa.compress(rank[ids].astype(np.int32).tobytes(), "zstd", asbytes=True)]), pa.array([words[order].tobytes()]),
            ], ["block", "tokens", "docs", "held", "sizes", "ids", "words"])

        for b in batches:
            size_of = np.array([v or 0 for v in pc.binary_length(b.column(2)).to_pylist()], np.int64)
            i = 0
            while i < b.num_rows:
                total = size + np.cumsum(size_of[i:])
                j = i + max(int(np.searchsorted(total, BLOCK, side="right")), 0 if held else 1)
                if j > i:
                    held.append(b.slice(i, j - i))
                    size += int(size_of[i:j].sum())
                if j < b.num_rows:
                    yield block()
                    held, size, n = [], 0, n + 1
                i = j
        if held:
            yield block()

    kind = docs.schema[key].dataType.simpleString()
    out = F.coalesce(F.crc32(F.col(quoted(key)).cast("string")) % 7 == 2, F.lit(False))
    return docs.select(quoted(key), out.alias("_held"), quoted(text)).mapInArrow(run, f"block long, tokens long, docs array<{kind}>, held array<boolean>, sizes binary, ids binary, words binary")


class Read:
    """A block row: its tokens with their contexts, and its distinct bigrams in the order of the shards."""

    def __init__(self, row: dict, bigrams: bool = True):
        self.block, self.docs, self.held = row["block"], row["docs"], np.array(row["held"], bool)
        self.sizes = np.frombuffer(row["sizes"], np.int32).astype(np.int64)
        self.ids = np.frombuffer(pa.decompress(row["ids"], 4 * int(self.sizes.sum()), "zstd"), np.int32)
        self.words = np.frombuffer(row["words"], np.uint64)
        self.trains = np.repeat(~self.held, self.sizes)
        self.counts = np.bincount(self.ids[self.trains], minlength=len(self.words))
        if bigrams:
            end = int(np.flatnonzero(self.words == _END)[0])
            both = np.empty(len(self.ids), np.int64)
            both[:1], both[1:] = end, self.ids[:-1]  # the token before a text's first is an end
            both <<= 32
            both |= self.ids
            self.pairs, self.back = distinct_of(both)
            del both
            self.u, self.w = self.pairs >> 32, self.pairs & 0xFFFFFFFF
            self.pair_counts = np.bincount(self.back[self.trains], minlength=len(self.pairs))

    def shards(self, n: int, hot: dict[int, int]) -> np.ndarray:
        """Shard of each distinct bigram."""
        h = mix(self.words)
        shard = (h % np.uint64(n)).astype(np.int64)[self.u]
        if hot:
            spread = np.array([hot.get(x, 1) for x in self.words.tolist()], np.int64)[self.u]
            shard = (shard + (mix(h + np.uint64(1)).astype(np.int64)[self.w] & (2**62 - 1)) % spread) % n
        return shard

    def asked(self, n: int, hot: dict[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Each shard with its distinct bigrams, the contexts it is asked for, and the bigrams of each.

        All shards of a hot context are asked for its tables, also those that none of this block's bigrams is dealt to.
        """
        shard = self.shards(n, hot)
        here = np.zeros(len(self.words), bool)
        here[self.u] = True
        wide: dict[int, list[int]] = {}
        for i in np.flatnonzero(here).tolist() if hot else ():
            x = int(self.words[i])
            if x in hot:
                for k in {(int(mix(self.words[i : i + 1])[0]) % n + j) % n for j in range(hot[x])}:
                    wide.setdefault(k, []).append(i)
        own = dict(_in_order(shard, n))
        for k in sorted(own.keys() | wide.keys()):
            at = own.get(k, np.empty(0, np.int64))
            u = np.union1d(self.u[at], np.array(wide.get(k, []), np.int64))
            yield k, at, u, np.bincount(np.searchsorted(u, self.u[at]), minlength=len(u))


def _rows(batches) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _in_order(values: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each number below n that occurs, and where, in a fixed order."""
    order = np.argsort(values, kind="stable")
    ends = np.searchsorted(values[order], np.arange(n + 1))
    for k in range(n):
        if ends[k + 1] > ends[k]:
            yield k, order[ends[k] : ends[k + 1]]


def _grouped(batches, name: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of equal ``name``, which come together."""
    at, held = None, []
    for row in _rows(batches):
        if held and row[name] != at:
            whole, held = held, []
            yield at, whole
            whole.clear()
        at = row[name]
        held.append(row)
    if held:
        whole, held = held, []
        yield at, whole
        whole.clear()
    pa.default_memory_pool().release_unused()  # the worker lives on


def hot_words(blocks: DataFrame, shards: int) -> dict[int, int]:
    """Contexts with more than a quarter of a shard's share of the tokens: word, number of shards.  At most 4 * shards."""

    def run(batches):
        for row in _rows(batches):
            x = Read(row, bigrams=False)
            n = int(x.counts.sum())
            top = np.flatnonzero(x.counts * 4 * shards > max(n, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(x.words[top].view(np.int64), 0)), pa.array(np.append(x.counts[top], n)), pa.array(np.append(np.zeros(len(top), bool), True))], ["word", "n", "every"])

    got = blocks.mapInArrow(run, "word long, n long, every boolean").groupBy("word", "every").agg(F.sum("n").alias("n"))
    total = got.where("every").agg(F.sum("n")).first()[0] or 1
    top = got.where(f"NOT every AND n * {4 * shards} > {total}").collect()
    return {r.word & (2**64 - 1): int(-(-2 * r.n * shards // total)) for r in top}


def bigram_requests(blocks: DataFrame, shards: int, hot: dict[int, int]) -> DataFrame:
    def run(batches):
        for row in _rows(batches):
            x = Read(row)
            for k, at, u, run_of in x.asked(shards, hot):
                yield pa.RecordBatch.from_arrays([
                    pa.array([k], pa.int32()), pa.array([x.block]), pa.array([x.words[u].tobytes()]), pa.array([pack(run_of)]),
                    pa.array([short(x.words[x.w[at]])]), pa.array([pack(x.pair_counts[at])]),
                ], ["shard", "block", "u", "run", "w", "n"])

    return blocks.mapInArrow(run, "shard int, block long, u binary, run binary, w binary, n binary")


def leaves(requests: DataFrame, shards: int, hot: dict[int, int]) -> DataFrame:
    """Answers (kind 0: block, shard, a: customers of each bigram and its tables by sample, b: tables of each context by sample)
    and tables that go up (kind 1: shard of the word, a: words, b: tables by sample, total: their sums)."""

    def answer(batches):
        for shard, rows in _grouped(batches, "shard"):
            us, ws = [np.frombuffer(r["u"], np.uint64) for r in rows], [long(r["w"]) for r in rows]
            runs, ns = [unpack(r["run"], len(u)) for r, u in zip(rows, us, strict=True)], [unpack(r["n"], len(w)) for r, w in zip(rows, ws, strict=True)]
            asked = [(r["block"], len(u), len(w)) for r, u, w in zip(rows, us, ws, strict=True)]
            contexts, of = np.unique(np.concatenate(us), return_inverse=True)
            home = np.repeat(of, np.concatenate(runs))
            rows.clear()
            del us, runs
            n = np.concatenate(ns)
            del ns
            every = np.concatenate(ws)
            del ws
            words, dish = distinct_of(every)
            del every
            home <<= 32
            home |= dish
            del dish
            pairs, back = distinct_of(home)
            del home
            c = np.bincount(back, n, len(pairs)).astype(np.int64)
            del n
            known = np.flatnonzero(c)
            spread = np.array([min(hot.get(x, 1), shards) for x in contexts.tolist()], np.int64) if hot else np.ones(len(contexts), np.int64)
            seated = np.zeros((SAMPLES, len(pairs)), np.int32)
            seated[:, known] = sample_shard(c[known], pairs[known] >> 32, pairs[known] & 0xFFFFFFFF, spread, 1000 + shard)
            total = np.stack([np.bincount(pairs >> 32, t, len(contexts)).astype(np.int64) for t in seated])
            at = at_u = 0
            for block, n_u, n_w in asked:
                i = back[at : at + n_w]
                yield _out(0, block, shard, pack(np.concatenate((c[i], seated[:, i].ravel()))), pack(total[:, of[at_u : at_u + n_u]].ravel()), [0] * SAMPLES)
                at, at_u = at + n_w, at_u + n_u
            up = np.stack([np.bincount(pairs & 0xFFFFFFFF, t, len(words)).astype(np.int64) for t in seated])
            some = np.flatnonzero(up[0])
            for k, i in _in_order((mix(words[some]) % np.uint64(shards)).astype(np.int64), shards):
                yield _out(1, -1, k, short(words[some[i]]), pack(up[:, some[i]].ravel()), up[:, some[i]].sum(axis=1).tolist())

    def _out(kind, block, shard, a, b, total):
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([block]), pa.array([shard], pa.int32()), pa.array([a]), pa.array([b]), pa.array([total], pa.list_(pa.int64()))], ["kind", "block", "shard", "a", "b", "total"])

    dealt = requests.repartition(shards, "shard").sortWithinPartitions("shard", "block")
    return dealt.mapInArrow(answer, "kind int, block long, shard int, a binary, b binary, total array<long>")


def word_requests(blocks: DataFrame, shards: int) -> DataFrame:
    def run(batches):
        for row in _rows(batches):
            x = Read(row, bigrams=False)
            for k, at in _in_order((mix(x.words & _SHORT) % np.uint64(shards)).astype(np.int64), shards):
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([x.block]), pa.array([k], pa.int32()), pa.array([x.words[at].tobytes()]), pa.array([pack(x.counts[at])])], ["kind", "block", "shard", "a", "b"])

    return blocks.mapInArrow(run, "kind int, block long, shard int, a binary, b binary")


def roots(asked: DataFrame, up_tables: DataFrame, shards: int, customers: list[int]) -> DataFrame:
    """Answers: block, shard, a: training count of each word, b: its customers and tables in the parent by sample; on
    the rows of block -1 the shard's training tokens, distinct training words and tables by sample."""

    def answer(batches):
        for shard, rows in _grouped(batches, "shard"):
            asking = [r for r in rows if r["kind"] == 0]
            words, back = np.unique(np.concatenate([np.frombuffer(r["a"], np.uint64) for r in asking]), return_inverse=True)
            count = np.zeros(len(words), np.int64)
            at, places = 0, []
            for r in asking:
                i = back[at : at + len(r["a"]) // 8]
                at += len(i)
                count[i] += unpack(r["b"], len(i))
                places.append((r["block"], i))
            names, of = np.unique(words & _SHORT, return_inverse=True)
            up = np.zeros((SAMPLES, len(names)), np.int64)
            for r in rows:
                if r["kind"] == 1:
                    some = np.searchsorted(names, long(r["a"]))
                    up[:, some] += unpack(r["b"], SAMPLES * len(some)).reshape(SAMPLES, -1)  # each word once in a row
            known = np.flatnonzero(up[0])
            rng = np.random.default_rng(77 + shard)
            seated = np.zeros_like(up)
            for k in range(SAMPLES):
                share = max(up[k].sum() / max(customers[k], 1), 1e-9)
                seated[k, known] = sample_root(up[k, known], share / (len(known) + share), share, rng)
            for block, i in places:
                yield _out(block, shard, count[i], np.concatenate((up[:, of[i]], seated[:, of[i]])).ravel(), 0, 0, [0] * SAMPLES)
            yield _out(-1, shard, count[:0], count[:0], int(count.sum()), int((count > 0).sum()), seated.sum(axis=1).tolist())

    def _out(block, shard, a, b, tokens, distinct, seated):
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([shard], pa.int32()), pa.array([pack(a)]), pa.array([pack(b)]), pa.array([tokens]), pa.array([distinct]), pa.array([seated], pa.list_(pa.int64()))], ["block", "shard", "a", "b", "tokens", "distinct", "tables"])

    both = asked.unionByName(up_tables.select("kind", "block", "shard", "a", "b")).repartition(shards, "shard").sortWithinPartitions("shard")
    return both.mapInArrow(answer, "block long, shard int, a binary, b binary, tokens long, distinct long, tables array<long>")


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score for every text."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    blocks = written(tokenized(docs, key, text), "blocks")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(blocks.agg(F.sum("tokens")).first()[0] or 0) // SHARD_TOKENS))
    hot = hot_words(blocks, shards)
    leaf = written(leaves(bigram_requests(blocks, shards, hot), shards, hot), "leaves")
    up_tables = leaf.where("kind = 1")
    sums = lambda df, name: [int(x or 0) for x in df.agg(*(F.sum(F.col(name)[i]) for i in range(SAMPLES))).first()]
    customers = sums(up_tables, "total")
    root = written(roots(word_requests(blocks, shards), up_tables, shards, customers), "roots")
    said = root.where("block = -1").agg(F.sum("tokens"), F.sum("distinct")).first()
    tokens, distinct, seated = int(said[0] or 0), int(said[1] or 0), sums(root.where("block = -1"), "tables")
    out_kind = to_arrow_type(kind)

    def finish(batches):
        for _, rows in _grouped(batches, "block"):
            x = Read(next(r for r in rows if r["kind"] == 2))
            del x.trains, x.counts, x.pair_counts
            n, m = len(x.words), len(x.pairs)
            shard_of = (mix(x.words & _SHORT) % np.uint64(shards)).astype(np.int64)
            count, parent_c, parent_t = np.zeros(n, np.int64), np.zeros((SAMPLES, n), np.int64), np.zeros((SAMPLES, n), np.int64)
            word_at, pair_at = dict(_in_order(shard_of, shards)), {k: (at, u) for k, at, u, _ in x.asked(shards, hot)}
            c, t, home_t = np.zeros(m, np.int32), np.zeros((SAMPLES, m), np.int32), np.zeros((SAMPLES, n), np.int64)
            for r in rows:
                if r["kind"] == 1:
                    at = word_at[r["shard"]]
                    count[at] = unpack(r["a"], len(at))
                    both = unpack(r["b"], 2 * SAMPLES * len(at)).reshape(2 * SAMPLES, -1)
                    parent_c[:, at], parent_t[:, at] = both[:SAMPLES], both[SAMPLES:]
                elif r["kind"] == 0:
                    at, u = pair_at[r["shard"]]
                    both = unpack(r["a"], (1 + SAMPLES) * len(at)).reshape(1 + SAMPLES, -1)
                    c[at], t[:, at] = both[0], both[1:]
                    home_t[:, u] += unpack(r["b"], SAMPLES * len(u)).reshape(SAMPLES, -1)
            rows.clear()
            del word_at, pair_at
            p = np.zeros(m)
            for k in range(SAMPLES):
                parent = (parent_c[k] - D_ROOT * parent_t[k] + (S_ROOT + D_ROOT * seated[k]) / (distinct + 1)) / (S_ROOT + customers[k])
                p += (c - D_LEAF * t[k] + (S_LEAF + D_LEAF * home_t[k])[x.u] * parent[x.w]) / (S_LEAF + count[x.u]) / SAMPLES
            sums = lambda v: np.add.reduceat(v, np.cumsum(x.sizes) - x.sizes)
            del c, t
            base = np.log10((count + 1) / (tokens + distinct + 1))
            yield pa.RecordBatch.from_arrays([
                pa.array(x.docs, out_kind), pa.array(x.held), pa.array(x.sizes), pa.array(sums((count > 0).astype(np.int64)[x.ids])), pa.array(np.full(len(x.sizes), tokens)),
                pa.array(sums(base[x.ids])), pa.array(sums(np.log10(p)[x.back])),
            ], ["_key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    none = [F.lit(None).cast(t).alias(c) for c, t in (("docs", f"array<{kind.simpleString()}>"), ("held", "array<boolean>"), ("sizes", "binary"), ("ids", "binary"), ("words", "binary"))]
    answers = leaf.where("kind = 0").select("kind", "block", "shard", "a", "b", *none)
    words = root.where("block >= 0").select(F.lit(1).alias("kind"), "block", "shard", "a", "b", *none)
    own = blocks.select(F.lit(2).alias("kind"), "block", F.lit(0).alias("shard"), F.lit(None).cast("binary").alias("a"), F.lit(None).cast("binary").alias("b"), "docs", "held", "sizes", "ids", "words")
    all_of = answers.unionByName(words).unionByName(own).repartition(shards, "block").sortWithinPartitions("block", "kind", "shard")
    out = all_of.mapInArrow(finish, f"_key {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out = written(out.withColumnRenamed("_key", key), "scores")
    discard(blocks, leaf, root)
    return out


def query(docs: DataFrame) -> DataFrame:
    return score(docs)
