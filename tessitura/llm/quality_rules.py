"""Quality rules by weak supervision, in Spark's own functions only.

Each rule looks at a few counts of a text and votes *keep* (2), *reject* (0) or
abstains (1).  No rule is trusted beforehand: expectation-maximisation over the
observed vote patterns estimates, for each rule, how often it casts each vote on
good and on bad texts, and the posterior probability of being good decides.

The patterns are bounded (three votes for each of eight rules: at most 6,561),
so the EM runs as one fold over an array of at most that many entries, whatever
the size of the corpus; its input is an ordinary partial aggregation.

Repeated windows are compared by a 64-bit hash of their three words, within one text.

Defined results: null and empty texts have no words and fail the base rule; repeated rows
and rows with equal or null keys are judged one by one and alike; keys may be of any type;
a rule that is exactly at a limit keeps or abstains, as its comparison says; posteriors at
the threshold keep; very long texts are counted whole, in arrays of one row; other columns
are not looked at by ``judge`` and carried by ``keep_good``, whatever their names; an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import quoted, written

ROUNDS = 20
#: Prior of each rule's votes (reject, abstain, keep) on good and on bad texts, and its
#: weight as a share of all texts.  It keeps the two classes from turning into "one kind
#: of junk" and "all else", as plain maximum likelihood does when rules overlap.
VOTES_GOOD, VOTES_BAD, PRIOR_WEIGHT = (0.01, 0.1, 0.89), (0.4, 0.1, 0.5), 0.1
SMOOTHING = 1.0
PRIOR_GOOD = 0.8

#: name: (reject if, keep if) over the counts of ``measure``; otherwise abstain.
RULES = {
    "symbols": ("n_symbols > 0.1 * n_words", "n_symbols <= 0.02 * n_words"),
    "marks": ("n_marks > 0.6 * n_words", "n_marks <= 0.35 * n_words"),
    "runs": ("n_runs > 0.02 * n_words", "n_runs = 0"),
    "bars": ("n_bars > 0.1 * n_words", "n_bars = 0"),
    "word_length": ("word_chars < 2.5 * n_words OR word_chars > 12 * n_words", "word_chars >= 3 * n_words AND word_chars <= 9 * n_words"),
    "lines": ("n_dup_lines > 0.5 * n_lines", "n_dup_lines <= 0.1 * n_lines"),
    "windows": ("n_repeat_words > 0.4 * n_words", "n_repeat_words <= 0.1 * n_words"),
    "variety": ("n_distinct < 0.15 * n_words AND n_distinct < 300", "n_distinct >= 0.4 * n_words OR n_distinct >= 300"),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"

MARKS_SQL = "'!()*+,-./:;<=>?@[]^_{|}~#$%&0123456789'"
RUNS_SQL = "'[#*$%&|<>]{3}'"
# \x09 to \x0D, for translate()
_WHITE = "concat(' ', decode(unhex('090A0B0C0D'), 'UTF-8'))"


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the five contract counts and n_lines, n_distinct, n_bars, n_marks, n_runs (all long); one pass, no shuffle."""
    t = docs.select(F.col(quoted(key)).alias("_key"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("_t"))
    t = t.selectExpr(
        "_key", "_t", f"array_remove(split(translate(_t, {_WHITE}, '      '), ' '), '') AS _w",
        r"filter(split(_t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]') AS _l",
    )
    t = t.selectExpr("*", "size(_w) AS _n")
    t = t.selectExpr("*", "sort_array(transform(sequence(0, greatest(_n, 3) - 3), i -> named_struct('h', xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2)), 'i', i))) AS _s")
    t = t.selectExpr("*", "sort_array(transform(filter(_s, (x, j) -> (j > 0 AND _s[j - 1].h = x.h) OR (j < _n - 3 AND _s[j + 1].h = x.h)), x -> x.i)) AS _p")
    long = lambda e: f"CAST({e} AS BIGINT)"
    return t.selectExpr(
        f"_key AS `{key}`",
        f"{long('_n')} AS n_words",
        f"{long(f'length(translate(_t, {_WHITE}, ' + chr(39) * 2 + '))')} AS word_chars",
        f"{long('length(_t) - length(translate(_t, ' + repr('#*$%&|<>') + ', ' + chr(39) * 2 + '))')} AS n_symbols",
        f"{long('size(_l) - size(array_distinct(_l))')} AS n_dup_lines",
        "CASE WHEN _n < 4 THEN 0L ELSE aggregate(_p, named_struct('e', 0, 'n', 0L), (a, x) -> named_struct('e', x + 3, 'n', a.n + x + 3 - greatest(a.e, x)), a -> a.n) END AS n_repeat_words",
        f"{long('size(_l)')} AS n_lines",
        f"{long('size(array_distinct(_w))')} AS n_distinct",
        f"{long('length(_t) - length(translate(_t, ' + repr('|') + ', ' + chr(39) * 2 + '))')} AS n_bars",
        f"{long(f'length(_t) - length(translate(_t, {MARKS_SQL}, {chr(39) * 2}))')} AS n_marks",
        f"{long(f'regexp_count(_t, {RUNS_SQL})')} AS n_runs",
    )


def votes(measured: DataFrame) -> DataFrame:
    """``measured`` and one int column ``vote_<rule>`` for each rule: 0 reject, 1 abstain, 2 keep."""
    return measured.selectExpr("*", *(f"CASE WHEN n_words = 0 THEN 1 WHEN {no} THEN 0 WHEN {yes} THEN 2 ELSE 1 END AS vote_{k}" for k, (no, yes) in RULES.items()))


def accuracies(voted: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row ``model``: [log prior odds, then for each rule the log likelihood ratio of votes 0, 1, 2]."""
    names = [f"vote_{k}" for k in RULES]
    size = 3 * len(names)
    patterns = voted.groupBy(*names).agg(F.count("*").alias("n"))
    one = patterns.agg(F.sort_array(F.collect_list(F.struct(F.array(*names).alias("v"), F.col("n").cast("double").alias("n")))).alias("pats"))
    one = one.selectExpr("pats", "greatest(coalesce(aggregate(pats, 0D, (a, x) -> a + x.n), 0D), 1D) AS total")
    # first guess: the prior
    q = [f"array({', '.join(f'{x}D' for x in v)})" for v in (VOTES_GOOD, VOTES_BAD)]
    w = f"{PRIOR_WEIGHT}D * total"
    first = f"concat(array(ln({PRIOR_GOOD} / {1 - PRIOR_GOOD})), flatten(transform(sequence(1, {len(names)}), k -> transform(sequence(0, 2), c -> ln({q[0]}[c] / {q[1]}[c])))))"
    odds = f"m[0] + aggregate(sequence(0, {len(names) - 1}), 0D, (a, k) -> a + m[1 + 3 * k + x.v[k]])"
    weighed = f"transform(pats, x -> named_struct('v', x.v, 'n', x.n, 'g', x.n / (1D + exp(-({odds})))))"
    # z: patterns with their good mass; g: good mass of all
    good = "aggregate(z, 0D, (a, x) -> a + x.g)"
    cell = lambda what, prior: f"aggregate(z, {w} * {prior}[c % 3], (a, x) -> a + CASE WHEN x.v[CAST(c / 3 AS INT)] = c % 3 THEN {what} ELSE 0D END)"
    ratios = f"transform(sequence(0, {size - 1}), c -> ln({cell('x.g', q[0])} / (g + {w})) - ln({cell('x.n - x.g', q[1])} / (total - g + {w})))"
    step = (
        "aggregate(array({weighed}), CAST(array() AS ARRAY<DOUBLE>), (u1, z) -> aggregate(array({good}), CAST(array() AS ARRAY<DOUBLE>), (u2, g) ->"
        " concat(array(ln((g + {s}D) / (total - g + {s}D))), {ratios})))"
    ).format(weighed=weighed, good=good, ratios=ratios, s=SMOOTHING)
    return one.selectExpr(f"aggregate(sequence(1, {rounds}), {first}, (m, r) -> {step}) AS model")


def posterior(model: Column | str = "model") -> Column:
    """Probability of being good, from the votes of the row and a column ``model``."""
    odds = " + ".join([f"{model}[0]", *(f"{model}[{1 + 3 * k} + vote_{name}]" for k, name in enumerate(RULES))])
    return F.expr(f"1D / (1D + exp(-({odds})))")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Counts, votes, posterior, base_failed and kept for every document."""
    voted = votes(written(measure(docs, key, text), "quality"))
    model = accuracies(voted)
    out = voted.crossJoin(F.broadcast(model))  # the model is one row of 25 numbers
    out = out.withColumn("p_good", posterior()).drop("model").withColumn("base_failed", F.expr(BASE_FAILED))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Whole rows travel with their counts through the one pass, so no text is shuffled.
    """
    rows = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), F.col(quoted(text)).alias("text"))
    return judge(rows, "row", "text", threshold).where("kept").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def query(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", *COUNTS, "base_failed", "kept")


def oracle_sql(rounds: int = ROUNDS) -> str:
    """The same for DuckDB: each EM round is one common table expression."""
    ks = list(enumerate(RULES))
    chars = lambda s: f"length(t) - length(translate(t, '{s}', ''))"
    sql = rf"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
pos AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
win AS (SELECT doc_id, i, a || ' ' || lead(a, 1) OVER q || ' ' || lead(a, 2) OVER q AS g FROM pos WINDOW q AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win WHERE g IS NOT NULL) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
m AS MATERIALIZED (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, ({chars('#*$%&|<>')})::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, len(list_distinct(w))::BIGINT AS n_distinct,
  ({chars('|')})::BIGINT AS n_bars,
  (length(t) - length(translate(t, {MARKS_SQL}, '')))::BIGINT AS n_marks, len(regexp_extract_all(t, {RUNS_SQL}))::BIGINT AS n_runs FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id),
v AS MATERIALIZED (SELECT *, {', '.join(f'CASE WHEN n_words = 0 THEN 1 WHEN {no} THEN 0 WHEN {yes} THEN 2 ELSE 1 END AS v{k}' for k, (no, yes) in enumerate(RULES.values()))} FROM m),
p AS MATERIALIZED (SELECT {', '.join(f'v{k}' for k, _ in ks)}, count(*)::DOUBLE AS n FROM v GROUP BY ALL),
e0 AS MATERIALIZED (SELECT ln({PRIOR_GOOD} / {1 - PRIOR_GOOD}) AS b, {', '.join(f'ln({VOTES_GOOD[c] / VOTES_BAD[c]!r}) AS r{k}{c}' for k, _ in ks for c in range(3))}),
"""
    odds = "b + " + " + ".join(f"CASE v{k} WHEN 0 THEN r{k}0 WHEN 1 THEN r{k}1 ELSE r{k}2 END" for k, _ in ks)
    s = SMOOTHING
    for i in range(1, rounds + 1):
        w = f"{PRIOR_WEIGHT} * sum(n)"
        cells = ", ".join(f"ln((coalesce(sum(g) FILTER (v{k} = {c}), 0) + {w} * {VOTES_GOOD[c]}) / (sum(g) + {w})) - ln((coalesce(sum(n - g) FILTER (v{k} = {c}), 0) + {w} * {VOTES_BAD[c]}) / (sum(n - g) + {w})) AS r{k}{c}" for k, _ in ks for c in range(3))
        sql += f"w{i} AS MATERIALIZED (SELECT p.*, n / (1 + exp(-({odds}))) AS g FROM p, e{i - 1}), e{i} AS MATERIALIZED (SELECT ln((sum(g) + {s}) / (sum(n - g) + {s})) AS b, {cells} FROM w{i}),\n"
    return sql + f"""f AS (SELECT doc_id, {', '.join(COUNTS)}, ({BASE_FAILED}) AS base_failed, 1 / (1 + exp(-({odds}))) AS p_good FROM v, e{rounds})
SELECT doc_id, {', '.join(COUNTS)}, base_failed, NOT base_failed AND p_good >= 0.5 AS kept FROM f"""
