"""Line dedup, repeated strings, decontamination, language model, classifier: against brute force and held-out rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import contaminations, lines_left, words

from tessitura.llm import decontaminate, line_dedup, minhash, pitman_yor, quality_classifier, seating, substring_dedup

SCHEMA = "doc_id long, text string, line string, id long, block long, word string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", -i, 0, "w") for i, t in enumerate(texts)], SCHEMA)


def prose(seed, n):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(400)]
    return [" ".join(r.choice(vocabulary) for _ in range(n)) for _ in range(1)][0]


# line dedup ----------------------------------------------------------------------
def test_lines_against_all_pairs(spark):
    r = random.Random(3)
    base = [prose(i, n) for i, n in enumerate((12, 3, 5, 8, 17, 18, 19, 20, 22, 30, 60, 20, 20))] + ["é" + prose(50, 6), "日本語" * 3 + prose(51, 16)]
    pool = base + [b[: (k := r.randrange(len(b)))] + "#" + b[k + 1 :] for b in base for _ in range(4)] + ["", " ", "short", "short", "abc", "É" * 9, "\t"]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randint(1, 9))) for _ in range(60)] + ["", None, "\n\n", "x" * 50_000]
    got = {r.doc_id: (r.n_lines_removed, r.text or "") for r in line_dedup.drop_lines(table(spark, texts)).collect()}
    want = lines_left(list(enumerate(texts)))
    assert got == want


def test_lines_keep_columns_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "same line here", "a"), (1, "same line here", "b"), (2, "same line here", "c"), (2, "same line here", "d"), (3, None, "e")], "doc_id long, text string, class string")
    out = line_dedup.drop_lines(docs)
    assert out.columns == ["doc_id", "text", "class", "n_lines_removed"]
    assert {r["class"]: r.text for r in out.collect()} == {"a": "same line here", "b": "same line here", "c": "", "d": "", "e": None}
    assert line_dedup.drop_lines(docs.limit(0)).collect() == []


@pytest.mark.parametrize("rule, size, common, most", [("long", 45, 40, 2), ("short", 33, 26, 8)])
def test_pairs_of_lines_at_the_threshold_share_a_bucket(rule, size, common, most):
    # 5,000 pairs of sets at the threshold (0.8 and 0.65): 0.1 and 2 are missed on average
    whole = 2 * size - common
    _, _, n_bands, rows = line_dedup.RULES[rule]
    h = np.random.default_rng(4).integers(0, 2**64, (5000, whole), dtype=np.uint64)
    one, two = (minhash.bands(minhash.signatures(h[:, s].ravel(), np.arange(5000) * size, rows * n_bands, seed=11), rows) for s in (slice(0, size), slice(whole - size, whole)))
    assert (~(one == two).any(axis=1)).sum() <= most


def edited(line, k, word):
    """``line`` with one character, or one word, changed."""
    if not word:
        return line[:k] + "#" + line[k + 1 :]
    w = line.split()
    w[k % len(w)] = "zwölf"
    return " ".join(w)


def test_short_lines_with_one_character_or_word_changed(spark):
    r = random.Random(8)
    lines = [prose(300 + i, 30)[:n] for i, n in enumerate(range(28, 80, 2))]
    texts = [t for i, x in enumerate(lines) for t in (x, edited(x, r.randrange(len(x)), False))]
    lines = [" ".join(f"w{300 * i + k}ab" for k in range(n)) for i, n in enumerate(range(9, 14))]  # words of six letters, lines of 62 to 97
    texts += [t for x in lines for t in (x, edited(x, r.randrange(5), True))]
    texts += ["Page 12 of 300 in the book of all things", "Page 13 of 300 in the book of all things"]
    got = [r.n_lines_removed for r in line_dedup.drop_lines(table(spark, texts)).orderBy("doc_id").collect()]
    assert got == [0, 1] * (len(texts) // 2)


def test_lines_with_keys_of_text_and_clashing_names(spark):
    columns = ["id", "mark", "row", "lines", "left", "numbers", "_gone", "_id", "n_lines_removed"]
    docs = spark.createDataFrame([("a", "one line that comes twice", *("x" * 9)), ("b", "one line that comes twice", *("x" * 9))], ", ".join(f"{c} string" for c in ["doc_id", "text", *columns]))
    out = line_dedup.drop_lines(docs)
    assert out.columns == ["doc_id", "text", *columns] and sorted(r.n_lines_removed for r in out.collect()) == [0, 1]
    assert {r.row + r.left + r.id for r in out.collect()} == {"xxx"}


# repeated strings ----------------------------------------------------------------
def strings_brute(texts, window):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(hash(b[p : p + window]) for b in raws for p in range(len(b) - window + 1))
    out = {}
    for i, b in enumerate(raws):
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - window + 1):
            if seen[hash(b[p : p + window])] > 1:
                gone[p : p + window] = True
        left = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out[i] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest())
    return out


def check_strings(spark, texts, window=40, anchor=10):
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.query(table(spark, texts), window, anchor).collect()}
    assert got == strings_brute(texts, window)


def test_repeated_strings(spark):
    r = random.Random(1)
    shared = [prose(i, 30) for i in range(5)]
    texts = [prose(100 + i, 20) + r.choice(shared)[r.randrange(60) : r.randrange(60, 180)] + prose(200 + i, 10) for i in range(40)]
    check_strings(spark, [*texts, "a" * 500, "a" * 39, "a" * 40, "ab" * 300, "é" * 100, texts[0], texts[0][5:], "", None])


def test_repeated_strings_across_pieces(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", 300)
    x = prose(5, 300)
    check_strings(spark, [x, prose(6, 20) + x[700:1500] + prose(7, 20), prose(8, 400), "z" * 1000])


def test_repeated_strings_at_the_window_of_production_and_by_the_join(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    want = strings_brute([r.text for r in rows], 400)
    want = {r.doc_id: want[i] for i, r in enumerate(rows)}
    assert {r.doc_id: tuple(r)[1:] for r in substring_dedup.query(docs).collect()} == want
    monkeypatch.setattr(substring_dedup, "MOST_SPOTS", -1)
    assert {r.doc_id: tuple(r)[1:] for r in substring_dedup.query(docs).collect()} == want


def test_repeated_strings_empty(spark):
    assert substring_dedup.query(table(spark, [])).collect() == []


# decontamination -----------------------------------------------------------------
def test_passages_with_changed_added_and_lost_words_are_found_and_nothing_else(spark):
    items = [prose(i, 20) for i in range(30)] + [None, "", "too short", prose(77, 6)]
    bench = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id long, first_word string")
    r = random.Random(2)
    texts, want = [], set()
    for i in range(30):
        w = items[i].split()
        if i % 3 == 0:
            w[4], w[11] = "changed", "other"
        elif i % 3 == 1:
            w.insert(9, "added")
        texts.append(" ".join([prose(500 + i, 40), *w, prose(600 + i, 40)]).upper() if i % 2 else " ".join([prose(500 + i, 40), *w]))
        want.add((i, i))
    texts += [prose(900 + i, 200) for i in range(30)] + ["", None, items[33], "a b c"]
    want.add((62, 33))
    docs = table(spark, texts)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == want
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, slice_bytes=300).collect()} == want
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == len(texts) - len({d for d, _ in want})
    assert decontaminate.contaminated(docs.limit(0), bench).collect() == [] and decontaminate.contaminated(docs, bench.limit(0)).collect() == []


def test_contamination_equals_brute_force_on_a_whole_table(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    want = contaminations({r.doc_id: r.text for r in docs.collect()}, {r.item_id: r.text for r in bench.collect()})
    assert want and {(r.doc_id, r.item_id) for r in decontaminate.query(docs, bench).collect()} == want


def test_windows_do_not_cross_documents():
    seeds = decontaminate.Seeds([1], ["a b c d e f g h i j k l"])
    assert seeds.search(pa.array(["a b c d e f", "g h i j k l"])) == []


# language model ------------------------------------------------------------------
def test_scores(spark):
    texts = [prose(i % 7, 60) + " " + prose(i, 15) for i in range(60)] + ["", None, "Ab ab", "ab  AB\n", "z" * 3000]
    got = {r.doc_id: r for r in pitman_yor.query(table(spark, texts)).collect()}
    tokens = {i: [*words(t), None] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = collections.Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        g = got[i]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[i], len(t), sum(w in c for w in t), n)
        assert math.isclose(g.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert g.score < 0
    assert sum(got[i].score for i in got if held[i]) > sum(got[i].base_score for i in got if held[i])


def test_block_and_shard_borders_change_only_the_sampling(spark, monkeypatch):
    texts = [prose(i % 5, 80) for i in range(30)]
    one = {r.doc_id: r.score for r in pitman_yor.query(table(spark, texts)).collect()}
    monkeypatch.setattr(pitman_yor, "BLOCK", 1500)
    two = {r.doc_id: r.score for r in pitman_yor.query(table(spark, texts)).collect()}
    assert all(abs(one[i] - two[i]) < 0.1 * abs(one[i]) for i in one)


def test_predictive_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    c = rng.integers(1, 300, 50)
    home, dish = np.repeat([0, 1], 25), np.concatenate((np.arange(25), np.arange(10, 35)))
    for t in pitman_yor.sample_shard(c, home, dish, np.ones(2, np.int64), 5):
        assert (t >= 1).all() and (t <= c).all() and (t[c == 1] == 1).all()
        up = np.bincount(dish, t).astype(np.int64)
        root = pitman_yor.sample_root(up, 1 / 36, 1.0, rng)
        rest = pitman_yor.S_ROOT + pitman_yor.D_ROOT * root.sum()
        parent = np.append(up - pitman_yor.D_ROOT * root + rest / 36, rest / 36) / (pitman_yor.S_ROOT + up.sum())
        assert math.isclose(parent.sum(), 1)
        for k in (0, 1):
            mine = np.zeros(36)
            mine[dish[home == k]] = (c - pitman_yor.D_LEAF * t)[home == k]
            p = (mine + (pitman_yor.S_LEAF + pitman_yor.D_LEAF * t[home == k].sum()) * parent) / (pitman_yor.S_LEAF + c[home == k].sum())
            assert math.isclose(p.sum(), 1)


def stirling_rows(d, sizes):
    """Rows of generalised Stirling numbers (logarithms), by their recursion."""
    row, out = np.array([0.0]), {1: np.array([0.0])}
    for m in range(1, max(sizes)):
        t = np.arange(1, m + 1)
        stay, new = np.append(row + np.log(m - d * t), -np.inf), np.append(-np.inf, row)
        row = np.logaddexp(stay, new)
        if m + 1 in sizes:
            out[m + 1] = row
    return out


@pytest.mark.parametrize("d", [pitman_yor.D_LEAF, pitman_yor.D_ROOT])
def test_tables_of_a_dish_follow_the_exact_distribution(d):
    """Mean tables for small and large dishes, within and beyond the table of Stirling numbers."""
    sizes = (6, 20, 100, 128, 1000, 1500, 3000)
    rng = np.random.default_rng(2)
    for n, row in stirling_rows(d, sizes).items():
        t = np.arange(1, n + 1)
        for weight in (0.05, 0.5, 5, 60) if n > 1 else ():
            odds = np.exp(row + t * math.log(weight) - (row + t * math.log(weight)).max())
            want = (odds * t).sum() / odds.sum()
            k = 20_000 if n <= 1000 else 500
            got = seating.tables(np.full(k, n), np.full(k, float(weight)), d, rng).mean()
            assert abs(got - want) < (0.02 if n <= 1000 else 0.08) * want, (n, weight, got, want)


def test_production_sweeps_reach_the_long_run():
    """Tables by dish size after the sweeps of production, from the first seating, against 40 sweeps more."""
    rng = np.random.default_rng(3)
    c = np.minimum(rng.zipf(1.6, 6000), 3000)
    home, dish = np.arange(6000) // 60, rng.permutation(6000) % 900
    few = pitman_yor.sample_shard(c, home, dish, np.ones(100, np.int64), 7)
    many = pitman_yor.sample_shard(c, home, dish, np.ones(100, np.int64), 8, samples=40)[-20:]
    for low, high in ((2, 20), (20, 128), (128, 1000), (1000, 3001)):
        some = (c >= low) & (c < high)
        assert some.sum() > 10 and abs(few[:, some].mean() / many[:, some].mean() - 1) < 0.05


def test_held_out_perplexity_is_not_above_kneser_ney(spark):
    """sf0.01 whole: against an interpolated Kneser-Ney bigram of the same vocabulary, with one unknown word."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    pairs, tests = collections.Counter(), []
    for r in rows:
        held = zlib.crc32(str(r.doc_id).encode()) % 7 == 2
        before = None
        for w in [*words(r.text), None]:
            tests.append((before, w)) if held else pairs.update([(before, w)])
            before = w
    follow, kinds, after = collections.Counter(), collections.Counter(), collections.Counter()
    for (u, w), n in pairs.items():
        follow[u] += n
        kinds[u] += 1
        after[w] += 1
    d, kn = 0.75, 0.0
    for u, w in tests:
        one = max(after[w] - d, 0) / len(pairs) + d * len(after) / len(pairs) / (len(after) + 1)
        kn += math.log10((max(pairs[u, w] - d, 0) + d * kinds[u] * one) / follow[u]) if follow[u] else math.log10(one)
    ours = sum(r.score for r in pitman_yor.query(docs).where("held_out").collect())
    assert ours >= kn, (10 ** (-ours / len(tests)), 10 ** (-kn / len(tests)))


def test_scores_with_keys_of_text_repeated_rows_and_clashing_names(spark):
    docs = spark.createDataFrame([("a", "x y z", 1, 2), ("a", "x y z", 1, 2), (None, "x y", 1, 2)], "doc_id string, text string, block long, _held long")
    got = pitman_yor.query(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == ["None", "a", "a"]
    assert len({r.score for r in got if r.doc_id == "a"}) == 1


def test_scores_of_an_empty_table(spark):
    assert pitman_yor.query(table(spark, [])).collect() == []


# classifier ----------------------------------------------------------------------
def test_classifier_on_planted_junk(spark):
    good = [prose(i, 120).replace(" a", ". A") for i in range(150)]
    bad = [" ".join(f"{w}%%%" for w in prose(i, 80).split()) for i in range(12)] + [("again " * 150) for _ in range(12)] + [prose(i, 90).replace(" ", " | ") for i in range(12)]
    texts = good + bad + ["", None, " \n "]
    got = {r.doc_id: r for r in quality_classifier.classify(table(spark, texts)).collect()}
    assert sum(got[i].kept for i in range(150)) >= 148
    assert sum(got[i].kept for i in range(150, 186)) <= 1
    assert not any(got[i].kept for i in range(186, 189))
    assert quality_classifier.classify(table(spark, [])).collect() == []


def test_classifier_against_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_classifier.query(docs).join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad), (sum(good), len(good), sum(bad), len(bad))


def votes_brute(patterns, counts, rounds):
    """EM over vote patterns in plain Python: log odds and log ratios."""
    k, total = len(patterns[0]), sum(counts)
    priors = (quality_classifier.VOTES_GOOD, quality_classifier.VOTES_BAD)
    tables = [[list(p) for _ in range(k)] for p in priors]
    odds, weight = math.log(4), quality_classifier.PRIOR_WEIGHT * total
    for _ in range(rounds):
        g = [n / (1 + math.exp(-(odds + sum(math.log(tables[0][i][v] / tables[1][i][v]) for i, v in enumerate(x))))) for x, n in zip(patterns, counts, strict=True)]
        masses = (g, [n - x for n, x in zip(counts, g, strict=True)])
        tables = [[[(sum(m for m, x in zip(mass, patterns, strict=True) if x[i] == v) + weight * p[v]) / (sum(mass) + weight) for v in range(3)] for i in range(k)] for mass, p in zip(masses, priors, strict=True)]
        odds = math.log((sum(g) + 1) / (total - sum(g) + 1))
    return [odds, *(math.log(a / b) for x, y in zip(*tables, strict=True) for a, b in zip(x, y, strict=True))]


def test_vote_model_equals_plain_em():
    r = random.Random(4)
    patterns = sorted({tuple(r.choice((0, 1, 2, 2)) for _ in range(9)) for _ in range(40)})
    counts = [r.randint(1, 500) for _ in patterns]
    got = quality_classifier.fit_votes(np.array(patterns), np.array(counts, float), 12)
    assert np.allclose(got, votes_brute(patterns, counts, 12), rtol=1e-9)


@pytest.mark.parametrize("sizes", [(10, 20), (200, 400)])
def test_vote_model_is_finite(sizes):
    p = np.array([[2] * 9, [0] * 9])
    assert np.isfinite(quality_classifier.fit_votes(p, np.array(sizes, float))).all()
