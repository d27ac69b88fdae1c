"""Queries over the production path: WAV bytes and files, Arrow fingerprints, libraries, matching, the service.

The event signals stand in for recordings, each normalised; ``catalogue`` has the same
steps in long form, and the same SQL checks both.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura import metrics
from tessitura.algorithms import algorithm
from tessitura.operators import spectrum as spec
from tessitura.operators import subband as sub
from tessitura.params import ALGORITHMS, BANDS, Params
from tessitura.plans.catalogue import _FRAMES, _H, _HASHES, _MATCH, _NORM, _SIG, _SPECTRUM, _W, BOUNDS, PARAMS, TOP, query, rounded
from tessitura.serve import Service
from tessitura.sources import wav
from tessitura.sources.files import put_file
from tessitura.sources.library import ALGORITHM_CODES, Library, import_library
from tessitura.sources.tables import event_signals, table

RATE = 44100
SUBBAND = Params(win_size=_W, hop_size=_H, window_func="hann", algo="subband")


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, samples, error: one row for each event signal; names sort as the signals do."""
    signals = spec.normalized(event_signals(spark, sf_dir))
    rows = signals.groupBy("signal_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sample"))), lambda x: x["sample"]).alias("samples"))
    return rows.select(F.format_string("signal_%02d.wav", F.col("signal_id")).alias("name"), "samples", F.lit(None).cast("string").alias("error"))


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="shared-")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


_NAME = "printf('signal_%02d.wav', signal_id)"
_PCM = "trunc(sample * 32767)::INT / 32768.0::DOUBLE"


# WAV ------------------------------------------------------------------------------
@query(f"WITH {_NORM} SELECT {_NAME} AS name, pos::INT AS pos, round({_PCM}, 6) AS sample FROM norm")
def wav_round_trip(spark, sf_dir):
    """EncodeWAV, then DecodeWAV."""
    raw = recordings(spark, sf_dir).select("name", wav.encoded(F.col("samples"), RATE).alias("raw"))
    return rounded(raw.select("name", wav.decoded("raw").alias("d")).select("name", F.posexplode("d.samples").alias("pos", "sample")), "sample")


def _pcm(depth: int, values: list[int], tag: int = 1) -> bytes:
    width = depth // 8
    data = b"".join((v % (1 << depth)).to_bytes(width, "little") for v in values)
    head = wav.encode([], RATE)
    return head[:20] + tag.to_bytes(2, "little") + head[22:34] + depth.to_bytes(2, "little") + b"data" + len(data).to_bytes(4, "little") + data


@query("""SELECT depth::INT AS depth, i::INT AS pos, round(CASE depth WHEN 8 THEN (i * 4 - 128) / 128.0::DOUBLE ELSE (i - 32) * (1::BIGINT << (depth - 6)::INT) / pow(2, depth - 1) END, 6) AS sample
FROM (VALUES (8), (16), (24), (32)) AS d(depth), range(64) AS r(i)""")
def wav_bit_depths(spark, sf_dir):
    """DecodeWAV at each depth, of a ramp over the whole range."""
    ramp = {d: _pcm(d, [i * 4 if d == 8 else (i - 32) << (d - 6) for i in range(64)]) for d in (8, 16, 24, 32)}
    raw = spark.createDataFrame([(d, bytearray(x)) for d, x in ramp.items()], "depth int, raw binary")
    return rounded(raw.select("depth", wav.decoded("raw").alias("d")).select("depth", F.posexplode("d.samples").alias("pos", "sample")), "sample")


@query("""SELECT * FROM (VALUES ('empty', 'file too short'), ('float', 'only PCM is supported'), ('magic', 'not a RIFF/WAVE file'), ('no data', 'no data chunk'), ('short', 'file too short'), ('twelve bits', 'unsupported bit depth 12'), ('fine', NULL)) AS v(kind, error)""")
def wav_bad_bytes(spark, sf_dir):
    """What DecodeWAV says of bytes that it can't read."""
    fine = _pcm(16, [1, 2, 3])
    twelve = _pcm(16, [1, 2, 3])
    cases = {"fine": fine, "empty": b"", "short": fine[:43], "magic": b"XXXX" + fine[4:], "float": _pcm(32, [0], 3), "no data": fine[:36] + b"none" + fine[40:], "twelve bits": twelve[:34] + (12).to_bytes(2, "little") + twelve[36:]}
    raw = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "kind string, raw binary")
    return raw.select("kind", wav.decoded("raw").getField("error").alias("error"))


_BAD = "SELECT 'broken.wav', NULL, NULL, 'not a RIFF/WAVE file'"


@query(f"WITH {_NORM} SELECT {_NAME} AS name, {RATE} AS sample_rate, count(*)::INT AS n_samples, NULL AS error FROM norm GROUP BY signal_id UNION ALL {_BAD}")
def wav_directory(spark, sf_dir):
    """WriteWAV by the tasks, the directory scan, and a bad file that keeps its error."""
    folder = _written(spark, sf_dir)
    return wav.read_directory(spark, folder).select("name", "sample_rate", F.size("samples").alias("n_samples"), "error").withColumn("n_samples", F.when(F.col("error").isNull(), F.col("n_samples")))


def _written(spark, sf_dir) -> str:
    folder = shared_folder(spark, "recordings")
    wav.write_directory(recordings(spark, sf_dir), folder, RATE)
    put_file(f"{folder}/broken.wav", b"no music" * 9)
    put_file(f"{folder}/notes.txt", b"not a recording")
    return folder


@query(f"WITH {_NORM}, w AS (SELECT signal_id, pos, {_PCM} AS sample FROM norm) SELECT {_NAME} AS name, count(*) AS n_samples, round(sum(sample * (pos % 97)), 3) AS weighed FROM w GROUP BY signal_id")
def wav_data_source(spark, sf_dir):
    """The same files through the ``wav`` data source: samples in order."""
    from tessitura.sources.datasource import WavSource

    spark.dataSource.register(WavSource)
    rows = spark.read.format("wav").load(_written(spark, sf_dir)).where("error IS NULL").select("name", F.posexplode("samples").alias("pos", "sample"))
    return rows.groupBy("name").agg(F.count("*").alias("n_samples"), F.round(F.sum(F.col("sample") * (F.col("pos") % 97)), 3).alias("weighed"))


@query("SELECT page_id, regexp_extract(url, '[^/]*$') AS base FROM pages")
def base_names(spark, sf_dir):
    """The last part of a path."""
    return table(spark, sf_dir, "pages").select("page_id", wav.base_name(F.col("url")).alias("base"))


# fingerprints -----------------------------------------------------------------------
def _numbered(spark, sf_dir):
    return recordings(spark, sf_dir).select(F.substring("name", 8, 2).cast("long").alias("song_id"), "samples")


@query(f'WITH {_HASHES} SELECT signal_id AS song_id, hash, "offset" FROM hs')
def recording_hashes(spark, sf_dir):
    """The Arrow path of the pair-hash algorithm."""
    return algorithm("constellation").fingerprint(_numbered(spark, sf_dir), PARAMS, RATE)


_EDGES = sub.mel_edges(_W, RATE)
_BAND_ROWS = ", ".join(f"({b}, {lo}, {max(hi, lo + 1)})" for b, (lo, hi) in enumerate(zip(_EDGES[:BANDS], _EDGES[1:], strict=False)))


@query(f"""WITH {_SPECTRUM}, bands(b, lo, hi) AS (VALUES {_BAND_ROWS}), en AS (SELECT signal_id, frame, b, sum(mag * mag) / any_value(hi - lo) AS e FROM st JOIN bands ON bin >= lo AND bin < hi GROUP BY ALL),
nx AS (SELECT *, lead(e) OVER (PARTITION BY signal_id, frame ORDER BY b) AS next FROM en)
SELECT signal_id AS song_id, frame, sum(CASE WHEN e > next * (1 + 1e-9) THEN 1::BIGINT << b ELSE 0 END)::BIGINT AS bits FROM nx GROUP BY signal_id, frame""")
def recording_frames(spark, sf_dir):
    """The Arrow path of the sub-band algorithm."""
    return algorithm("subband").fingerprint(_numbered(spark, sf_dir), SUBBAND, RATE)


# libraries --------------------------------------------------------------------------
def _library(spark, sf_dir, params=PARAMS) -> Library:
    return Library.build(recordings(spark, sf_dir), params, RATE)


_SONGS = "sg AS (SELECT (row_number() OVER (ORDER BY signal_id) - 1)::BIGINT AS song_id, signal_id, n_frames::BIGINT AS num_frames FROM len)"


@query(f"""WITH {_FRAMES}, {_SONGS} SELECT song_id, {_NAME} AS name, num_frames, NULL AS error FROM sg
UNION ALL SELECT NULL, * FROM (VALUES ('bad.wav', NULL, 'no data chunk'), ('brief.wav', NULL, 'signal too short'))""")
def library_build(spark, sf_dir):
    """Songs that are indexed, with their frames, and those that are skipped."""
    more = spark.createDataFrame([("bad.wav", None, "no data chunk"), ("brief.wav", [0.5] * (_W + _H - 1), None)], "name string, samples array<double>, error string")
    built = Library.build(recordings(spark, sf_dir).unionByName(more), PARAMS, RATE)
    return built.songs.withColumn("error", F.lit(None).cast("string")).unionByName(built.skipped.select(F.lit(None).cast("long").alias("song_id"), "name", F.lit(None).cast("long").alias("num_frames"), "error"))


@query(f"""WITH {_HASHES}, {_SONGS}, n AS (SELECT signal_id, count(*) AS n FROM hs GROUP BY ALL)
SELECT song_id, {_NAME} AS name, num_frames, coalesce(n, 0) AS n_prints FROM sg LEFT JOIN n USING (signal_id)
UNION ALL SELECT song_id + (SELECT count(*) FROM sg), {_NAME}, num_frames, coalesce(n, 0) FROM sg LEFT JOIN n USING (signal_id) WHERE song_id = 0""")
def library_append(spark, sf_dir):
    """A library of one song before which all others are; ids go on after the largest."""
    whole = _library(spark, sf_dir)
    one = Library(PARAMS, whole.songs.where("song_id = 0"), whole.prints.where("song_id = 0"))
    rest = Library(PARAMS, whole.songs.where("song_id > 0").withColumn("song_id", F.col("song_id") - 1), whole.prints.where("song_id > 0").withColumn("song_id", F.col("song_id") - 1))
    both = one.append(rest).append(one)
    n = both.prints.groupBy("song_id").agg(F.count("*").alias("n_prints"))
    return both.songs.join(n, "song_id", "left").select("song_id", "name", "num_frames", F.coalesce("n_prints", F.lit(0)).alias("n_prints"))


@query(f"""WITH {_HASHES}, {_SONGS} SELECT {_NAME} AS name, hash, "offset", {_W} AS win_size, {_H} AS hop_size, 'hann' AS window_func, 'constellation' AS algo FROM hs JOIN sg USING (signal_id)""")
def library_saved(spark, sf_dir):
    """Save and load: names, prints and parameters."""
    path = shared_folder(spark, "library")
    _library(spark, sf_dir).save(path)
    got = Library.load(spark, path)
    return got.prints.join(got.songs, "song_id").select("name", "hash", "offset", *(F.lit(v).alias(k) for k, v in got.params.row().items()))


@query(f"""WITH {_HASHES}, {_SONGS} SELECT song_id, {_NAME} AS name, num_frames, hash, "offset" FROM sg LEFT JOIN hs USING (signal_id)""")
def library_packed(spark, sf_dir):
    """The binary format, written by the tasks and read back."""
    path = shared_folder(spark, "packed")
    _library(spark, sf_dir).write_packed(path)
    got = import_library(spark, path)
    return got.songs.join(got.prints, "song_id", "left").select("song_id", "name", "num_frames", "hash", "offset")


@query(f"""WITH {_FRAMES} SELECT count(*) AS songs, sum(n_frames)::BIGINT AS frames, sum(n_frames)::BIGINT AS prints, {_W} AS win_size, {_H} AS hop_size, 'hann' AS window_func, 'subband' AS algo FROM len""")
def library_packed_subband(spark, sf_dir):
    """The same for sub-band prints, and the facts of the library read back."""
    path = shared_folder(spark, "packed")
    _library(spark, sf_dir, SUBBAND).write_packed(path)
    return import_library(spark, path).stats()


@query(f"""WITH {_MATCH}, nm AS (SELECT DISTINCT signal_id, {_NAME} AS name FROM sig) SELECT sample_id, rank, name, round(score, 6) AS score, votes, delta AS "offset" FROM tk JOIN nm ON nm.signal_id = song_id""")
def library_match(spark, sf_dir):
    """Store.Match: every recording as a clip, against the library of all, in one plan."""
    clips = _numbered(spark, sf_dir).withColumnRenamed("song_id", "sample_id")
    return rounded(_library(spark, sf_dir).match(clips, TOP), "score")


@query(f"WITH {_FRAMES} SELECT signal_id AS sample_id, {_NAME} AS first FROM len WHERE n_frames > 0")
def noisy_match(spark, sf_dir):
    """AddNoise at query time: each noisy recording still finds its own song."""
    noisy = spec.with_noise(spec.normalized(event_signals(spark, sf_dir)), 0.01, 7)
    clips = noisy.groupBy("signal_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sample"))), lambda x: x["sample"]).alias("samples")).withColumnRenamed("signal_id", "sample_id")
    return _library(spark, sf_dir).match(clips, 1).select("sample_id", F.col("name").alias("first"))


@query(f"WITH {_SIG} SELECT signal_id, count(*) AS n, true AS within, true AS changed FROM sig GROUP BY signal_id")
def noise_bounds(spark, sf_dir):
    """AddNoise: every sample within the scale of the peak, and nearly all changed."""
    s = event_signals(spark, sf_dir)
    peak = s.groupBy("signal_id").agg(F.max(F.abs("sample")).alias("peak"))
    both = s.withColumnRenamed("sample", "was").join(spec.with_noise(s, 0.05, 3), ["signal_id", "pos"]).join(peak, "signal_id")
    return both.groupBy("signal_id").agg(F.count("*").alias("n"), F.bool_and(F.abs(F.col("sample") - F.col("was")) <= 0.05 * F.col("peak") + 1e-9).alias("within"), (F.count_if(F.col("sample") != F.col("was")) > 0.99 * F.count("*")).alias("changed"))


@query("SELECT * FROM (VALUES ('constellation', 0, 'hash'), ('subband', 1, 'song_id')) AS v(name, code, print_key)")
def algorithm_registry(spark, sf_dir):
    """Registered algorithms with their codes in the binary format."""
    return spark.createDataFrame([(n, ALGORITHM_CODES[n], algorithm(n).key) for n in ALGORITHMS if n in ALGORITHM_CODES], "name string, code int, print_key string")


# service ----------------------------------------------------------------------------
@query("SELECT * FROM (VALUES ('before loading', 503, 'library not loaded'), ('bytes', 400, 'not a RIFF/WAVE file'), ('brief', 400, 'signal too short'), ('large', 413, 'clip too large'), ('clip', 200, 'signal_03.wav')) AS v(request, status, answer)")
def service_answers(spark, sf_dir):
    """Status and answer of the match request."""
    service = Service(spark)
    rows = [("before loading", service.match(b""))]
    service.use(_library(spark, sf_dir))
    clip = recordings(spark, sf_dir).where("name = 'signal_03.wav'").first().samples  # one recording
    rows += [("bytes", service.match(b"x" * 60)), ("brief", service.match(wav.encode(np.zeros(_W), RATE))), ("large", service.match(None)), ("clip", service.match(wav.encode(clip, RATE)))]
    service.close()
    return spark.createDataFrame([(k, status, x["error"] if "error" in x else x["matches"][0]["name"]) for k, (status, x) in rows], "request string, status int, answer string")


@query("""WITH c AS (SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase', 'view') GROUP BY event_type),
h AS (SELECT """ + ", ".join(f"count(*) FILTER (value <= {b}) AS b{i}" for i, b in enumerate(BOUNDS)) + """, count(*) AS n, sum(value) AS s FROM events)
SELECT unnest(['# HELP events_total Events by type.', '# TYPE events_total counter']) AS line UNION ALL SELECT 'events_total{type="' || event_type || '"} ' || n FROM c
UNION ALL SELECT unnest(['# HELP event_value Values.', '# TYPE event_value histogram', """ + ", ".join(f"'event_value_bucket{{le=\"{int(b)}\"}} ' || b{i}" for i, b in enumerate(BOUNDS)) + """, 'event_value_bucket{le="+Inf"} ' || n, 'event_value_count ' || n]) FROM h""")
def metrics_exposition(spark, sf_dir):
    """The text form of a counter and a histogram, but for the line of the sum."""
    events = table(spark, sf_dir, "events")
    text = metrics.counter_text("events_total", "Events by type.", "type", metrics.counter(events, "event_type", ("click", "purchase", "view")))
    text += metrics.histogram_text("event_value", "Values.", BOUNDS, metrics.histogram(events, "value", BOUNDS))
    return spark.createDataFrame([(x,) for x in text.splitlines() if not x.startswith("event_value_sum")], "line string")
