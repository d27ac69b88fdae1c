"""Quality classifier from weak labels.

Overlapping heuristic labellers look at every document; expectation-maximisation over
the counts of their vote patterns (all documents; at most ``3 ** 9`` patterns) estimates
how each votes on good and bad texts.  The posterior is the training label of a logistic
scorer over hashed features, fitted on a documented, bounded sample: the ``SAMPLE``
documents whose key has the smallest hash.  The scorer is a fixed array of
``2 ** HASH_BITS`` numbers, so it is safe to broadcast, and it scores every document.

Of the sample, documents beyond ``SAMPLE_BYTES`` of text in all are left out, so the fit
on the driver is bounded in bytes too.

Defined results: texts that are null or have no word get no votes: their posterior is the
prior, their score 0, and they are not kept; repeated keys and rows are scored one by one,
and in the sample the longest text stands for a key; ties in the sample's hash are broken
by the key; scores at the threshold are kept; very long texts are counted whole; keys may
be of any type that can be ordered; other columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.llm.common import Tokens, hash_strings, mix, quoted, written

SAMPLE, SAMPLE_BYTES, HASH_BITS, ROUNDS = 4000, 64_000_000, 16, 30
#: prior of the votes (reject, abstain, keep) on good and on bad texts, and its weight as a share of all texts
VOTES_GOOD, VOTES_BAD, PRIOR_WEIGHT = (0.01, 0.1, 0.89), (0.4, 0.1, 0.5), 0.1
LABELLERS = ("symbol_words", "symbol_chars", "bars", "echoes", "one_word", "variety", "word_length", "shouting", "exclaims")


def _sums(values: np.ndarray, tokens: Tokens) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[tokens.starts[1:]] - total[tokens.starts[:-1]]


class Batch:
    """Per-document counts of a batch: one array for each, as long as the batch."""

    def __init__(self, texts: pa.Array):
        t = self.tokens = Tokens(texts, lower=False)
        n = self.n = t.lengths.astype(np.float64)
        words = t.words
        count = lambda pattern: pc.count_substring_regex(words, pattern).to_numpy(zero_copy_only=False).astype(np.float64)
        symbols = count(r"[#*$%&|<>]")
        self.symbol_chars = _sums(symbols[t.ids], t)
        self.symbol_words = _sums((count(r"[#*$%&<>]{2,}") > 0)[t.ids], t)
        self.bars = _sums((count(r"\|") > 0)[t.ids], t)
        self.shouts = _sums((count(r"^[^\p{Ll}]*\p{Lu}{2}[^\p{Ll}]*$") > 0)[t.ids], t)
        self.exclaims = _sums((count(r"[!?]{2}") > 0)[t.ids], t)
        self.chars = _sums(pc.utf8_length(words).to_numpy(zero_copy_only=False)[t.ids], t)
        same = np.zeros(len(t.ids), bool)
        same[1:] = t.ids[1:] == t.ids[:-1]
        same[t.starts[:-1][n > 0]] = False
        self.same = same
        self.echoes = _sums(same, t)
        # distinct words of each document with their counts, in document order
        doc = np.repeat(np.arange(len(n)), t.lengths)
        both, self.counts = np.unique(doc << 32 | t.ids, return_counts=True)
        self.doc, self.word = both >> 32, both & 0xFFFFFFFF
        self.distinct = np.bincount(self.doc, minlength=len(n)).astype(np.float64)
        self.most = np.zeros(len(n))
        np.maximum.at(self.most, self.doc, self.counts)

    def votes(self) -> np.ndarray:
        """documents x labellers: 0 reject, 1 abstain, 2 keep."""
        n = self.n
        rules = {
            "symbol_words": (self.symbol_words > 0.05 * n, self.symbol_words <= 0.005 * n),
            "symbol_chars": (self.symbol_chars > 0.1 * n, self.symbol_chars <= 0.02 * n),
            "bars": (self.bars > 0.1 * n, self.bars == 0),
            "echoes": (self.echoes > 0.2 * n, self.echoes <= 0.05 * n),
            "one_word": (self.most > 0.3 * n, self.most <= 0.2 * n),
            "variety": ((self.distinct < 0.2 * n) & (self.distinct < 200), (self.distinct >= 0.35 * n) | (self.distinct >= 300)),
            "word_length": ((self.chars < 2.5 * n) | (self.chars > 12 * n), (self.chars >= 3 * n) & (self.chars <= 9 * n)),
            "shouting": (self.shouts > 0.3 * n, self.shouts <= 0.1 * n),
            "exclaims": (self.exclaims > 0.05 * n, self.exclaims <= 0.005 * n),
        }
        out = np.stack([np.where(rules[k][0], 0, np.where(rules[k][1], 2, 1)) for k in LABELLERS], axis=1)
        out[n == 0] = 1
        return out

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """document, hashed feature, value: shares of words, of word shapes and of a few ratios."""
        t, n = self.tokens, np.maximum(self.n, 1)
        mask = np.uint64(2**HASH_BITS - 1)
        words = (hash_strings(t.words) & mask).astype(np.int64)
        shapes = pc.replace_substring_regex(pc.replace_substring_regex(t.words, r"\p{L}+", "a"), r"\p{N}+", "0")
        shape = (mix(hash_strings(shapes) ^ np.uint64(0x5A)) & mask).astype(np.int64)
        share = self.counts / n[self.doc]
        every = np.arange(len(n))
        ratios = {"echo": self.echoes / n, "most": self.most / n, "new": self.distinct / n, "long": self.chars / n / 10, "shout": self.shouts / n, "exclaim": self.exclaims / n, "symbol": self.symbol_words / n, "bar": self.bars / n, "one": np.ones(len(n))}
        name = hash_strings(pa.array([f"ratio {k}" for k in ratios], pa.large_string())) & mask
        doc = np.concatenate((self.doc, self.doc, *(every for _ in ratios)))
        feature = np.concatenate((words[self.word], shape[self.word], *(np.full(len(n), x, np.int64) for x in name)))
        return doc, feature, np.concatenate((share * 3, share * 3, *ratios.values()))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """[log prior odds, then log likelihood ratios, labellers x 3] by EM over vote patterns."""
    k = patterns.shape[1]
    total, weight = counts.sum(), PRIOR_WEIGHT * counts.sum()
    good, bad = (np.tile(np.array(p), (k, 1)) for p in (VOTES_GOOD, VOTES_BAD))
    odds = np.log(4.0)
    for _ in range(rounds):
        g = counts / (1 + np.exp(-(odds + (np.log(good / bad)[np.arange(k), patterns]).sum(axis=1))))
        for table, prior, mass in ((good, VOTES_GOOD, g), (bad, VOTES_BAD, counts - g)):
            for v in range(3):
                table[:, v] = (mass @ (patterns == v) + weight * prior[v]) / (mass.sum() + weight)
        odds = np.log((g.sum() + 1) / (total - g.sum() + 1))
    return np.concatenate(([odds], np.log(good / bad).ravel()))


def posterior(model: np.ndarray, votes: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(model[0] + model[1:].reshape(-1, 3)[np.arange(votes.shape[1]), votes].sum(axis=1))))


def fit_scorer(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, label: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights of a logistic scorer by full-batch Adam with a small L2 term."""
    w, m, v = (np.zeros(2**HASH_BITS) for _ in range(3))
    for i in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.bincount(doc, w[feature] * value, len(label))))
        g = np.bincount(feature, (p - label)[doc] * value, len(w)) / len(label) + 1e-6 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
    return w.astype(np.float32)


def label(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, votes int (digits of base 3, first labeller lowest; -1 for texts without words), size and mark (bytes and hash of the text)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = Batch(b.column(1))
                coded = np.where(x.n > 0, x.votes() @ 3 ** np.arange(len(LABELLERS)), -1)
                size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(coded, pa.int32()), size, b.column(2)], ["_key", "votes", "size", "mark"])

    rows = docs.select(F.col(quoted(key)).alias("_key"), quoted(text), F.xxhash64(quoted(text)).alias("mark"))
    return rows.mapInArrow(run, f"_key {kind}, votes int, size long, mark long").withColumnRenamed("_key", key)


def decoded(votes: np.ndarray) -> np.ndarray:
    return votes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def train(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """The vote model, from all documents, and the scorer's weights, from the sample."""
    rows = labelled.where("votes >= 0").groupBy("votes").count().collect()  # at most 3 ** 9 patterns
    if not rows:
        return np.zeros(1 + 3 * len(LABELLERS)), np.zeros(2**HASH_BITS, np.float32)
    model = fit_votes(decoded(np.array([r[0] for r in rows])), np.array([r[1] for r in rows], float))
    # of repeated keys the longest text stands for all; at most ``sample`` rows go through the window
    chosen = labelled.where("votes >= 0").select(F.col(quoted(key)).alias("_key"), "size", "mark").groupBy("_key").agg(F.max(F.struct("size", "mark")).alias("s"))
    chosen = chosen.select("_key", "s.size", "s.mark", F.xxhash64("_key").alias("_order")).orderBy("_order", "_key").limit(sample)
    chosen = chosen.withColumn("_sum", F.sum("size").over(Window.orderBy("_order", "_key").rowsBetween(Window.unboundedPreceding, -1)))
    chosen = chosen.where(f"_sum IS NULL OR _sum + size <= {SAMPLE_BYTES}").select("_key", "mark")

    def run(batches):
        for b in batches:
            x = Batch(b.column(0))
            doc, feature, value = x.features()
            order = np.argsort(doc, kind="stable")
            ends = np.cumsum(np.bincount(doc, minlength=b.num_rows))
            offsets = np.concatenate(([0], ends)).astype(np.int32)
            p = posterior(model, x.votes())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, feature[order].astype(np.int32)), pa.ListArray.from_arrays(offsets, value[order].astype(np.float32)), pa.array(p)], ["f", "v", "p"])

    some = docs.select(F.col(quoted(key)).alias("_key"), F.col(quoted(text)).alias("_text"), F.xxhash64(quoted(text)).alias("mark")).join(F.broadcast(chosen), ["_key", "mark"], "left_semi")
    some = some.dropDuplicates(["_key"]).orderBy(F.xxhash64("_key"), "_key").select("_text").mapInArrow(run, "f array<int>, v array<float>, p double")
    got = some.toArrow()  # bounded by the sample, in rows and bytes
    if not got.num_rows:
        return model, np.zeros(2**HASH_BITS, np.float32)
    f, v = (got.column(c).combine_chunks() for c in ("f", "v"))
    doc = np.repeat(np.arange(got.num_rows), np.diff(f.offsets.to_numpy()))
    return model, fit_scorer(doc, f.flatten().to_numpy().astype(np.int64), v.flatten().to_numpy().astype(np.float64), got.column("p").to_numpy())


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """key, weak_label (posterior of the labellers), score of the scorer, kept."""
    kind = docs.schema[key].dataType.simpleString()
    labelled = written(label(docs, key, text), "votes")
    model, weights = train(docs, labelled, key, text, sample)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = Batch(b.column(1))
                doc, feature, value = x.features()
                score = 1 / (1 + np.exp(-np.bincount(doc, weights[feature] * value, b.num_rows)))
                score[x.n == 0] = 0
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(posterior(model, x.votes())), pa.array(score), pa.array((score >= threshold) & (x.n > 0))], ["_key", "weak_label", "score", "kept"])

    return docs.select(F.col(quoted(key)).alias("_key"), quoted(text)).mapInArrow(run, f"_key {kind}, weak_label double, score double, kept boolean").withColumnRenamed("_key", key)


def query(docs: DataFrame) -> DataFrame:
    return classify(docs)
