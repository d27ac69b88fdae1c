"""Queries by name.  Each takes (spark, sf_dir); ``ORACLE_SQL`` has the same for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura import metrics
from tessitura.functions import heat_colour, lsh_keys, metric_number, rfc3339
from tessitura.operators import constellation as cons
from tessitura.operators import spectrum as spec
from tessitura.operators import subband as sub
from tessitura.params import BANDS, LSH_BITS, LSH_POSITIONS, POSTING_CAP, Params
from tessitura.sources.tables import embedding_bits, embedding_frames, event_signals, table

#: Small windows suit the event signals: 9 bins, so the peak radii are 2 x 3.
PARAMS = Params(win_size=16, hop_size=8, window_func="hann", peak_frames=2, peak_bins=3)
SMALL_CAP, TOP = 40, 5
CLIP_START, CLIP_FRAMES = 11, 20
BOUNDS = (50.0, 100.0, 200.0, 400.0)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# SQL that later queries stand on ------------------------------------------------
_W, _H = PARAMS.win_size, PARAMS.hop_size
_SIG = "sig AS (SELECT user_id % 10 AS signal_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) - 1 AS pos, value AS sample FROM events)"
_NORM = _SIG + ", norm AS (SELECT signal_id, pos, CASE WHEN m > 0 THEN sample / m ELSE sample END AS sample FROM (SELECT *, max(abs(sample)) OVER (PARTITION BY signal_id) AS m FROM sig))"
_FRAMES = _NORM + f""", len AS (SELECT signal_id, greatest((max(pos) + 1 - {_W}) // {_H}, 0)::INT AS n_frames, max(pos) + 1 AS n_samples FROM norm GROUP BY signal_id),
fr AS (SELECT n.signal_id, f.frame::INT AS frame, (n.pos - f.frame * {_H})::INT AS i, n.sample FROM (SELECT signal_id, unnest(range(n_frames)) AS frame FROM len) f
  JOIN norm n ON n.signal_id = f.signal_id AND n.pos BETWEEN f.frame * {_H} AND f.frame * {_H} + {_W - 1})"""
_SPECTRUM = _FRAMES + f""", fw AS (SELECT signal_id, frame, i, sample * (0.5 * (1 - cos(2 * pi() * i / {_W - 1}))) AS x FROM fr),
st AS MATERIALIZED (SELECT signal_id, frame, bin, sqrt(pow(sum(x * cos(2 * pi() * bin * i / {_W})), 2) + pow(sum(x * sin(2 * pi() * bin * i / {_W})), 2)) * 2 / {_W} AS mag
  FROM fw, (SELECT unnest(range({_W // 2 + 1}))::INT AS bin) GROUP BY signal_id, frame, bin)"""


def _peaks_sql(cells: str, out: str, frames: int, bins: int) -> str:
    return f""", {out}a AS (SELECT *, greatest(max(mag) OVER (r RANGE BETWEEN {bins} PRECEDING AND 1 PRECEDING), max(mag) OVER (r RANGE BETWEEN 1 FOLLOWING AND {bins} FOLLOWING)) AS beside
  FROM {cells} WINDOW r AS (PARTITION BY signal_id, frame ORDER BY bin)),
{out}b AS (SELECT *, greatest(mag, beside) AS stripe FROM {out}a),
{out}c AS (SELECT *, greatest(max(stripe) OVER (c RANGE BETWEEN {frames} PRECEDING AND 1 PRECEDING), max(stripe) OVER (c RANGE BETWEEN 1 FOLLOWING AND {frames} FOLLOWING)) AS around
  FROM {out}b WINDOW c AS (PARTITION BY signal_id, bin ORDER BY frame)),
{out} AS (SELECT signal_id, frame::INT AS frame, bin::INT AS bin FROM {out}c WHERE mag > 0 AND (beside IS NULL OR mag > beside) AND (around IS NULL OR mag > around))"""


_PEAKS = _SPECTRUM + _peaks_sql("st", "pk", PARAMS.peak_frames, PARAMS.peak_bins)
_HASHES = _PEAKS + """, pr AS (SELECT a.signal_id, a.frame::BIGINT AS "offset", ((a.bin & 1023) | ((t.bin & 1023) << 10) | (((t.frame - a.frame) & 4095) << 20))::BIGINT AS hash, t.frame AS target_frame, t.bin AS target_bin,
    row_number() OVER (PARTITION BY a.signal_id, a.frame, a.bin ORDER BY t.frame, t.bin) AS rn, a.bin AS own_bin
  FROM pk a JOIN pk t ON t.signal_id = a.signal_id AND t.frame - a.frame BETWEEN 2 AND 60 AND abs(t.bin - a.bin) <= 64),
hs AS MATERIALIZED (SELECT signal_id, "offset", hash, target_frame, target_bin, own_bin FROM pr WHERE rn <= 5)"""
_VOTES = _HASHES + f""", ci AS (SELECT * FROM hs QUALIFY count(*) OVER (PARTITION BY hash) <= {POSTING_CAP}), vt AS MATERIALIZED (SELECT s.signal_id AS sample_id, l.signal_id AS song_id, l."offset" - s."offset" AS delta, count(*) AS votes FROM hs s JOIN ci l ON l.hash = s.hash GROUP BY ALL),
bd AS (SELECT sample_id, song_id, delta, votes FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, song_id ORDER BY votes DESC, delta) AS rn FROM vt) WHERE rn = 1)"""
_MATCH = _VOTES + f""", nh AS (SELECT signal_id, count(*) AS n_hashes FROM hs GROUP BY signal_id),
tk AS (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY votes DESC, delta, song_id)::INT AS rank, song_id, votes / n_hashes AS score, votes, delta FROM bd JOIN nh ON nh.signal_id = sample_id QUALIFY rank <= {TOP})"""
_EMB = "em AS (SELECT label::BIGINT AS signal_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS frame, embedding::DOUBLE[] AS mags FROM embeddings)"
_BITS = _EMB + f", fp AS MATERIALIZED (SELECT signal_id, frame, list_sum(list_transform(range({BANDS - 1}), lambda i: CASE WHEN mags[i + 1] > mags[i + 2] THEN 1::BIGINT << i::INT ELSE 0 END))::BIGINT AS bits FROM em)"
_KEYS = ", ".join("({})::INT".format(" | ".join([str(n << LSH_BITS), *(f"(((bits >> {p}) & 1) << {i})" for i, p in enumerate(ps))])) for n, ps in enumerate(LSH_POSITIONS))
_LSH = _BITS + f""", ix0 AS (SELECT unnest([{_KEYS}]) AS lsh_key, signal_id AS song_id, frame FROM fp WHERE frame % 2 = 0 AND frame <= 65535),
ix AS (SELECT * FROM ix0 QUALIFY count(*) OVER (PARTITION BY lsh_key) <= 10000),
sm AS MATERIALIZED (SELECT signal_id AS sample_id, frame - {CLIP_START} AS frame, bits FROM fp WHERE frame BETWEEN {CLIP_START} AND {CLIP_START + CLIP_FRAMES - 1}),
lv AS MATERIALIZED (SELECT sample_id, song_id, delta, count(*) AS votes FROM (SELECT DISTINCT s.sample_id, ix.song_id, ix.frame - s.frame AS delta, s.frame AS at FROM (SELECT sample_id, frame, unnest([{_KEYS}]) AS lsh_key FROM sm) s JOIN ix USING (lsh_key)) GROUP BY ALL)"""
_SLIDE = """ns AS (SELECT sample_id, max(frame) + 1 AS n FROM sm GROUP BY ALL), nt AS (SELECT signal_id AS song_id, max(frame) + 1 AS n FROM fp GROUP BY ALL)"""


def _scores_sql(spots: str) -> str:
    return f"""sc AS (SELECT p.sample_id, p.song_id, p."offset", greatest(0, (1 - sum(bit_count(xor(s.bits, t.bits))) / (count(*) * {BANDS - 1}) - 0.5) * 2) AS score
  FROM {spots} p JOIN sm s ON s.sample_id = p.sample_id JOIN fp t ON t.signal_id = p.song_id AND t.frame = p."offset" + s.frame GROUP BY ALL),
bo AS (SELECT sample_id, song_id, score, "offset" FROM sc QUALIFY row_number() OVER (PARTITION BY sample_id, song_id ORDER BY score DESC, "offset") = 1)"""


# signals and spectra -------------------------------------------------------------
@query(f"WITH {_NORM} SELECT signal_id, pos, round(sample, 6) AS sample FROM norm")
def signal_normalize(spark, sf_dir):
    return rounded(spec.normalized(event_signals(spark, sf_dir)), "sample")


@query("SELECT i::INT AS i, round(0.5 * (1 - cos(2 * pi() * i / 31)), 6) AS w FROM range(32) AS r(i)")
def window_hann(spark, sf_dir):
    return rounded(spec.windows_table(spark, "hann", 32), "w")


@query("SELECT i::INT AS i, round(0.54 - 0.46 * cos(2 * pi() * i / 31), 6) AS w FROM range(32) AS r(i)")
def window_hamming(spark, sf_dir):
    return rounded(spec.windows_table(spark, "hamming", 32), "w")


@query("SELECT i::INT AS i, round(1 - abs(2.0::DOUBLE * i / 31 - 1), 6) AS w FROM range(32) AS r(i)")
def window_bartlett(spark, sf_dir):
    return rounded(spec.windows_table(spark, "bartlett", 32), "w")


@query(f"WITH {_FRAMES} SELECT signal_id, frame, i, round(sample, 6) AS sample FROM fr")
def frame_slice(spark, sf_dir):
    return rounded(spec.framed(spec.normalized(event_signals(spark, sf_dir)), PARAMS), "sample")


def _spectrum(spark, sf_dir):
    return spec.spectrogram(event_signals(spark, sf_dir), PARAMS)


@query(f"WITH {_SPECTRUM} SELECT signal_id, frame, bin, round(mag, 6) AS mag FROM st")
def stft_magnitude(spark, sf_dir):
    return rounded(spec.long_form(_spectrum(spark, sf_dir)), "mag")


@query(f"WITH {_SPECTRUM}, lg AS (SELECT signal_id, frame, bin, ln(1 + mag * 200) AS raw FROM st) SELECT signal_id, frame, bin, round(raw, 6) AS raw, round(raw / max(raw) OVER (PARTITION BY signal_id), 6) AS level FROM lg")
def log_spectrum(spark, sf_dir):
    return rounded(spec.log_scaled(_spectrum(spark, sf_dir)), "raw", "level")


_CTRL = "[[68, 1, 84], [72, 35, 116], [64, 67, 135], [52, 94, 141], [33, 144, 140], [53, 183, 121], [143, 215, 68], [253, 231, 37]]"


@query(f"""WITH v AS (SELECT i::INT AS i, i / 50.0::DOUBLE - 0.1::DOUBLE AS x FROM range(61) AS r(i)), y AS (SELECT i, greatest(least(x, 1), 0) * 7 AS t FROM v), z AS (SELECT i, t, least(floor(t), 6)::INT AS lo FROM y)
SELECT i, {', '.join(f'floor({_CTRL}[lo + 1][{c}] + ({_CTRL}[lo + 2][{c}] - {_CTRL}[lo + 1][{c}]) * (t - lo))::INT AS {n}' for c, n in ((1, 'r'), (2, 'g'), (3, 'b')))} FROM z""")
def heat_map_colours(spark, sf_dir):
    return spark.range(61).select(F.col("id").cast("int").alias("i"), heat_colour(F.col("id") / 50.0 - 0.1).alias("c")).select("i", "c.r", "c.g", "c.b")


# peaks and pairs -----------------------------------------------------------------
def _event_peaks(spark, sf_dir):
    return spec.peaks(spec.long_form(_spectrum(spark, sf_dir)), PARAMS.peak_frames, PARAMS.peak_bins)


@query(f"WITH {_PEAKS} SELECT * FROM pk")
def spectrum_peaks(spark, sf_dir):
    return _event_peaks(spark, sf_dir)


@query(f"WITH {_EMB}, ec AS (SELECT signal_id, frame, unnest(mags) AS mag, generate_subscripts(mags, 1) - 1 AS bin FROM em){_peaks_sql('ec', 'pk', 5, 12)} SELECT * FROM pk")
def embedding_peaks(spark, sf_dir):
    return spec.peaks(spec.long_form(embedding_frames(spark, sf_dir)), 5, 12)


def _hashes(spark, sf_dir):
    return cons.pair_hashes(_event_peaks(spark, sf_dir))


@query(f'WITH {_HASHES} SELECT signal_id, "offset", hash, target_frame, target_bin FROM hs')
def pair_hashes(spark, sf_dir):
    return _hashes(spark, sf_dir)


def _as_index(hashes):
    return hashes.select(F.col("signal_id").alias("song_id"), "hash", "offset")


def _both(spark, sf_dir):
    """Samples and index from one plan of hashes, so that their exchanges are shared."""
    hashes = _hashes(spark, sf_dir)
    return hashes.select(F.col("signal_id").alias("sample_id"), "hash", "offset", F.struct("offset", "hash").alias("entry_id")), _as_index(hashes)


def _probe(spark, sf_dir):
    """The same, with the index as matching has it: without saturated keys."""
    samples, index = _both(spark, sf_dir)
    return samples, cons.capped(index)


@query(f"""WITH {_HASHES} SELECT hash, count(*) AS n_postings, string_agg(signal_id || ':' || "offset", ' ' ORDER BY signal_id, "offset") AS postings FROM hs GROUP BY hash HAVING count(*) <= 10000""")
def posting_lists(spark, sf_dir):
    text = F.concat_ws(" ", F.transform("postings", lambda p: F.concat_ws(":", p["song_id"], p["offset"])))
    return cons.posting_lists(_as_index(_hashes(spark, sf_dir))).withColumn("postings", text)


@query(f"""WITH {_HASHES} SELECT signal_id AS song_id, hash, "offset" FROM hs QUALIFY count(*) OVER (PARTITION BY hash) <= {SMALL_CAP}""")
def posting_cap(spark, sf_dir):
    return cons.capped(_as_index(_hashes(spark, sf_dir)), "hash", SMALL_CAP).select("song_id", "hash", "offset")


@query(f"WITH {_VOTES} SELECT * FROM vt")
def vote_counts(spark, sf_dir):
    return cons.votes(*_probe(spark, sf_dir))


@query(f"WITH {_VOTES} SELECT * FROM bd")
def best_delta(spark, sf_dir):
    return cons.best_delta(cons.votes(*_probe(spark, sf_dir)))


@query(f"WITH {_MATCH} SELECT sample_id, rank, song_id, round(score, 6) AS score, votes, delta FROM tk")
def match_topk(spark, sf_dir):
    return rounded(cons.match(*_probe(spark, sf_dir), TOP), "score")


@query(f"WITH {_MATCH} SELECT sample_id, round(CASE WHEN max(score) FILTER (rank = 2) > 0 THEN max(score) FILTER (rank = 1) / max(score) FILTER (rank = 2) ELSE 0 END, 6) AS margin FROM tk GROUP BY sample_id")
def match_margin(spark, sf_dir):
    return rounded(cons.margins(cons.match(*_probe(spark, sf_dir), TOP)), "margin")


@query(f"""WITH {_HASHES}, e AS (SELECT DISTINCT signal_id, "offset", hash FROM hs), n AS (SELECT signal_id, count(*) AS n FROM hs GROUP BY ALL),
ag AS (SELECT s.signal_id AS sample_id, l.signal_id AS song_id, l."offset" - s."offset" AS delta, count(DISTINCT (s."offset", s.hash)) AS c FROM e s JOIN hs l ON l.hash = s.hash GROUP BY ALL)
SELECT sample_id, song_id, round(least(max(c) / any_value(n.n), 1), 6) AS similarity FROM ag JOIN n ON n.signal_id = sample_id GROUP BY sample_id, song_id""")
def pairwise_similarity(spark, sf_dir):
    return rounded(cons.similarity(*_both(spark, sf_dir)), "similarity")


# sub-bands -----------------------------------------------------------------------
_MEL = "mel AS (SELECT b, least(floor(700 * (pow(10, (2595 * log10(1 + 22050 / 700.0::DOUBLE)) * b / 41 / 2595) - 1) * 1024 / 44100 + 0.5)::INT, 512) AS edge FROM range(42) AS r(b))"


@query(f"WITH {_MEL} SELECT b::INT AS band, edge FROM mel")
def mel_edges(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(sub.mel_edges(1024, 44100))), "band int, edge int")


_MEL64 = "mel AS (SELECT b, least(floor(700 * (pow(10, (2595 * log10(1 + 22050 / 700.0::DOUBLE)) * b / 41 / 2595) - 1) * 126 / 44100 + 0.5)::INT, 63) AS edge FROM range(42) AS r(b))"


@query(f"""WITH {_EMB}, {_MEL64}, bd AS (SELECT b, edge AS lo, greatest(lead(edge) OVER (ORDER BY b), edge + 1) AS hi FROM mel), ec AS (SELECT signal_id, frame, unnest(mags) AS mag, generate_subscripts(mags, 1) - 1 AS bin FROM em)
SELECT signal_id, frame, b::INT AS band, round(sum(mag * mag) / any_value(hi - lo), 6) AS energy FROM ec JOIN bd ON bin >= lo AND bin < hi WHERE b < 40 GROUP BY ALL""")
def mel_energy(spark, sf_dir):
    # 64 bins, as a window of 126 samples has
    out = sub.mel_energies(embedding_frames(spark, sf_dir), 126, 44100)
    return rounded(out.select("signal_id", "frame", F.posexplode("energies").alias("band", "energy")), "energy")


@query(f"WITH {_EMB} SELECT signal_id, frame, i::INT AS bit, (mags[i + 1] > mags[i + 2])::INT AS value FROM em, range(39) AS r(i)")
def subband_bits(spark, sf_dir):
    from tessitura.functions import falling_bits

    return embedding_frames(spark, sf_dir).select("signal_id", "frame", F.posexplode(falling_bits(F.slice("mags", 1, BANDS))).alias("bit", "value"))


@query(f"WITH {_BITS} SELECT * FROM fp")
def subband_pack(spark, sf_dir):
    return embedding_bits(spark, sf_dir)


@query(f"WITH {_BITS} SELECT signal_id, frame, unnest([{_KEYS}]) AS lsh_key FROM fp")
def lsh_hash_keys(spark, sf_dir):
    return embedding_bits(spark, sf_dir).select("signal_id", "frame", F.explode(lsh_keys(F.col("bits"))).alias("lsh_key"))


def _songs(spark, sf_dir):
    return embedding_bits(spark, sf_dir).withColumnRenamed("signal_id", "song_id")


def _clips(spark, sf_dir):
    part = embedding_bits(spark, sf_dir).where(F.col("frame").between(CLIP_START, CLIP_START + CLIP_FRAMES - 1))
    return part.select(F.col("signal_id").alias("sample_id"), (F.col("frame") - CLIP_START).alias("frame"), "bits")


@query(f"WITH {_LSH} SELECT lsh_key, song_id, frame FROM ix")
def lsh_index(spark, sf_dir):
    return sub.lsh_index(_songs(spark, sf_dir))


@query(f"WITH {_LSH} SELECT * FROM lv")
def lsh_votes(spark, sf_dir):
    return sub.lsh_votes(_clips(spark, sf_dir), sub.lsh_index(_songs(spark, sf_dir)))


@query(f"""WITH {_LSH}, lb AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY votes DESC, delta, song_id) AS place FROM (SELECT * FROM lv QUALIFY row_number() OVER (PARTITION BY sample_id, song_id ORDER BY votes DESC, delta) = 1)),
{_SLIDE}, cd AS (SELECT sample_id, song_id, votes, greatest(delta - 8, 0) AS lo, least(delta + 8, nt.n - ns.n) AS hi FROM lb JOIN ns USING (sample_id) JOIN nt USING (song_id) WHERE place <= 10 AND votes >= 2),
sp AS (SELECT sample_id, song_id, unnest(range(lo, hi + 1)) AS "offset" FROM cd WHERE hi >= lo), {_scores_sql('sp')}
SELECT bo.sample_id, row_number() OVER (PARTITION BY bo.sample_id ORDER BY score DESC, bo.song_id)::INT AS rank, bo.song_id, round(score, 6) AS score, votes, "offset"::INT AS "offset"
FROM bo JOIN cd USING (sample_id, song_id) WHERE score > 0 QUALIFY rank <= {TOP}""")
def subband_match(spark, sf_dir):
    return rounded(sub.match(_clips(spark, sf_dir), _songs(spark, sf_dir), TOP), "score")


@query(f"""WITH {_LSH}, {_SLIDE}, sp AS (SELECT sample_id, song_id, unnest(range(0, nt.n - ns.n + 1)) AS "offset" FROM ns, nt), {_scores_sql('sp')}
SELECT ns.sample_id, nt.song_id, round(coalesce(score, -1), 6) AS score, "offset"::INT AS "offset" FROM ns CROSS JOIN nt LEFT JOIN bo ON bo.sample_id = ns.sample_id AND bo.song_id = nt.song_id""")
def hamming_best_offset(spark, sf_dir):
    clips, songs = _clips(spark, sf_dir), _songs(spark, sf_dir)
    pairs = clips.select("sample_id").distinct().crossJoin(songs.select("song_id").distinct())  # every pair is the result asked for
    return rounded(sub.full_slide(pairs, clips, songs), "score")


@query(f"""WITH {_BITS} SELECT a.signal_id AS a_id, b.signal_id AS b_id, round(greatest(0, (1 - sum(bit_count(xor(a.bits, b.bits))) / (count(*) * 39) - 0.5) * 2), 6) AS score FROM fp a JOIN fp b ON a.frame = b.frame GROUP BY ALL""")
def hamming_pairs(spark, sf_dir):
    f = embedding_bits(spark, sf_dir).withColumnRenamed("signal_id", "id")
    return rounded(sub.compared(f, f), "score")


# metrics and facts ---------------------------------------------------------------
@query("SELECT event_type, " + ", ".join(f"count(*) FILTER (value <= {b}) AS le_{int(b)}" for b in BOUNDS) + ", count(*) AS le_inf, round(sum(value), 6) AS sum FROM events GROUP BY event_type")
def histogram_buckets(spark, sf_dir):
    out = metrics.histogram(table(spark, sf_dir, "events"), "value", BOUNDS, ["event_type"])
    return rounded(out, "sum").select("event_type", *(F.col("buckets")[i].alias(f"le_{int(b)}") for i, b in enumerate(BOUNDS)), F.col("count").alias("le_inf"), "sum")


@query("SELECT event_type AS label, count(*) AS value FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY event_type")
def counter_by_label(spark, sf_dir):
    return metrics.counter(table(spark, sf_dir, "events"), "event_type", ("click", "view", "purchase"))


@query("SELECT event_type AS label, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY event_type")
def gauge_last(spark, sf_dir):
    return metrics.gauge(table(spark, sf_dir, "events"), "event_type", "value", F.struct("ts", "event_id"))


@query("""SELECT event_id, regexp_replace(printf('%.6f', value), '\\.?0+$', '') AS value_text, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS loaded_at FROM events""")
def metric_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", metric_number(F.col("value")).alias("value_text"), rfc3339(F.col("ts")).alias("loaded_at"))


@query(f"""WITH {_HASHES}, c AS (SELECT signal_id, count(*) AS n_hashes FROM hs GROUP BY ALL), p AS (SELECT signal_id, count(*) AS n_peaks FROM pk GROUP BY ALL)
SELECT len.signal_id, n_samples, n_frames, coalesce(n_peaks, 0) AS n_peaks, coalesce(n_hashes, 0) AS n_hashes, round(coalesce(n_hashes, 0) / (n_samples / 100.0::DOUBLE), 6) AS density FROM len LEFT JOIN c USING (signal_id) LEFT JOIN p USING (signal_id)""")
def hash_density(spark, sf_dir):
    signals = event_signals(spark, sf_dir)
    peaks = spec.peaks(spec.long_form(spec.spectrogram(signals, PARAMS)), PARAMS.peak_frames, PARAMS.peak_bins)
    count = lambda df, n: df.groupBy("signal_id").agg(F.count("*").alias(n))
    out = spec.lengths(signals, PARAMS).join(count(peaks, "n_peaks"), "signal_id", "left").join(count(cons.pair_hashes(peaks), "n_hashes"), "signal_id", "left").na.fill(0, ["n_peaks", "n_hashes"])
    # 100 samples a second
    return rounded(out.withColumn("density", F.col("n_hashes") / (F.col("n_samples") / 100.0)), "density")


@query(f"""WITH {_HASHES} SELECT (SELECT count(DISTINCT signal_id) FROM sig) AS n_songs, count(*) AS n_hashes, count(DISTINCT hash) AS n_keys, {_W} AS win_size, {_H} AS hop_size, 'hann' AS window_func FROM hs""")
def library_stats(spark, sf_dir):
    songs = event_signals(spark, sf_dir).select(F.countDistinct("signal_id").alias("n_songs"))
    facts = _hashes(spark, sf_dir).agg(F.count("*").alias("n_hashes"), F.countDistinct("hash").alias("n_keys"))
    return songs.crossJoin(facts).select("*", F.lit(_W).alias("win_size"), F.lit(_H).alias("hop_size"), F.lit("hann").alias("window_func"))  # one row each
