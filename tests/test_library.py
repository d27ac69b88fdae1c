import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F
from signals import RATE, tone, tune

from tessitura import metrics
from tessitura.params import Params
from tessitura.serve import Service, server
from tessitura.sources.datasource import register
from tessitura.sources.library import Library, import_library, parse
from tessitura.sources.wav import encode, read_directory
from tessitura.streaming import clip_stream, match_stream, request_rates

SONGS = 6


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("songs")
    for i in range(SONGS):
        (path / f"song_{i}.wav").write_bytes(encode(tune(i, 5), RATE))
    (path / "bad.wav").write_bytes(b"x")
    (path / "short.wav").write_bytes(encode(tone(440, 0.01), RATE))
    return path


@pytest.fixture(scope="module", params=["constellation", "subband"])
def library(spark, folder, request, tmp_path_factory):
    built = Library.build(read_directory(spark, str(folder)), Params(algo=request.param))
    assert {r.name: r.error for r in built.skipped.collect()} == {"bad.wav": "file too short", "short.wav": "signal too short"}
    path = str(tmp_path_factory.mktemp("library"))
    built.save(path)
    return Library.load(spark, path)


def clip_of(i, gain=1.0, noise=0.0):
    x = tune(i, 5)[2 * RATE // 512 * 512 :][: 2 * RATE] * gain
    return np.clip(x + noise * np.random.default_rng(9).uniform(-1, 1, len(x)), -1, 1)


def test_batch_of_clips(spark, library):
    clips = spark.createDataFrame([(10, clip_of(4).tolist()), (11, clip_of(2, 0.5).tolist()), (12, clip_of(3, 1, 0.03).tolist())], "sample_id long, samples array<double>")
    rows = library.match(clips).orderBy("sample_id", "rank").collect()
    best = {r.sample_id: r for r in rows if r["rank"] == 1}
    assert {k: v.name for k, v in best.items()} == {10: "song_4.wav", 11: "song_2.wav", 12: "song_3.wav"}
    assert abs(best[10].offset - 2 * RATE // 512) <= 1
    second = {r.sample_id: r.score for r in rows if r["rank"] == 2}
    assert all(best[k].score > second.get(k, 0) for k in best)


def test_binary_format_round_trip(spark, library, tmp_path):
    raw = b"".join(library.export())
    params, songs = parse(raw)
    assert params == library.params and len(songs) == SONGS
    (tmp_path / "lib.bin").write_bytes(raw)
    back = import_library(spark, str(tmp_path / "lib.bin"))
    rows = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    assert rows(back.prints) == rows(library.prints.select(back.prints.columns)) and rows(back.songs) == rows(library.songs)
    for cut in (10, 40, len(raw) - 1):
        with pytest.raises(ValueError):
            parse(raw[:cut])
    with pytest.raises(ValueError):
        parse(b"XXXX" + raw[4:])


def test_append_and_stats(library):
    both = library.append(library)
    assert both.songs.count() == 2 * SONGS and both.prints.count() == 2 * library.prints.count()
    assert library.stats().first().songs == SONGS


def test_similarity_to_itself_is_highest(spark, library):
    prints = library.fingerprint(spark.createDataFrame([(0, clip_of(4).tolist())], "sample_id long, samples array<double>"))
    best = library.similarity(prints).orderBy(F.desc("similarity")).first()
    assert best.song_id == 4 and best.similarity > 0.5


def test_stream_of_clips(spark, folder, tmp_path):
    library = Library.build(read_directory(spark, str(folder)), Params())
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "clip.wav").write_bytes(encode(clip_of(3), RATE))
    match_stream(clip_stream(spark, str(tmp_path / "in")), library, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).where("rank = 1").collect()
    assert [(r.clip, r.name) for r in rows] == [("clip.wav", "song_3.wav")]


def test_request_rates_plan(spark):
    s = spark.readStream.format("rate").load().selectExpr("timestamp AS ts", "'ok' AS status", "0.1D AS elapsed")
    assert request_rates(s).isStreaming


def test_table_function_and_source(spark, folder):
    register(spark)
    spark.read.format("binaryFile").load(str(folder / "song_0.wav")).createOrReplaceTempView("files")
    assert spark.sql("SELECT p.* FROM files, LATERAL fingerprint_wav(content) p").count() > 10
    assert spark.read.format("wav").load(str(folder)).where("error IS NULL").count() == SONGS + 1


def test_http(spark, folder):
    service = Service(spark)
    http = server(service, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{http.server_address[1]}"

    def call(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(url + path, data=body)) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    assert call("/readyz")[0] == 503 and call("/v1/match", b"x")[0] == 503 and call("/healthz")[0] == 200
    service.use(Library.build(read_directory(spark, str(folder)), Params()))
    status, body = call("/v1/match", encode(clip_of(4), RATE))
    out = json.loads(body)
    assert status == 200 and out["matches"][0]["name"] == "song_4.wav" and (len(out["matches"]) < 2 or out["margin"] == out["matches"][0]["score"] / out["matches"][1]["score"])
    assert call("/v1/match", b"junk")[0] == 400
    service.max_body = 10
    assert call("/v1/match", encode(clip_of(4), RATE))[0] == 413
    assert json.loads(call("/v1/stats")[1])["songs"] == SONGS
    assert 'match_requests_total{status="ok"} 1' in call("/metrics")[1]
    http.shutdown()


def test_metric_text(spark):
    df = spark.createDataFrame([(0.05,), (0.3,), (0.7,), (2.0,)], "v double")
    text = metrics.histogram_text("d", "help", (0.5, 0.1, 1.0), metrics.histogram(df, "v", (0.5, 0.1, 1.0)))
    assert [x for x in text.split("\n") if x.startswith("d_")] == ['d_bucket{le="0.1"} 1', 'd_bucket{le="0.5"} 2', 'd_bucket{le="1"} 3', 'd_bucket{le="+Inf"} 4', "d_sum 3.05", "d_count 4"]
    assert [metrics.number_text(v) for v in (1.0, 0.5, 1e-7, float("inf"), float("nan"))] == ["1", "0.5", "0", "+Inf", "NaN"]


def test_cli_analysis_of_a_chirp(tmp_path, capsys):
    from tessitura.__main__ import main

    main(["analyze", "--out", str(tmp_path)])
    assert "frames: 127" in capsys.readouterr().out and (tmp_path / "spectrogram.png").read_bytes().startswith(b"\x89PNG")


# additions to a library, algorithms, parts of the format, life of the server -----------------
def one_song(spark, name, seed):
    return Library.build(spark.createDataFrame([(name, tune(seed, 1).tolist(), None)], "name string, samples array<double>, error string"), Params())


def test_songs_appended_to_one_song_get_ids_of_their_own(spark):
    both = one_song(spark, "a", 1).append(one_song(spark, "b", 2))
    assert sorted((r.song_id, r.name) for r in both.songs.collect()) == [(0, "a"), (1, "b")]
    clip = spark.createDataFrame([(0, tune(2, 1).tolist())], "sample_id long, samples array<double>")
    assert both.match(clip, 1).first().name == "b"


def test_equal_names_and_equal_recordings_are_songs_of_their_own(spark):
    rows = [("x", tune(1, 1).tolist(), None), ("x", tune(2, 1).tolist(), None), ("x", tune(2, 1).tolist(), None)]
    built = Library.build(spark.createDataFrame(rows, "name string, samples array<double>, error string"), Params())
    assert sorted(r.song_id for r in built.songs.collect()) == [0, 1, 2]
    n = {r.song_id: r["count"] for r in built.prints.groupBy("song_id").count().collect()}
    assert len(n) == 3 and len(set(n.values())) == 2


def test_an_algorithm_can_be_registered(spark):
    from tessitura import algorithms, params

    class Level:
        """One print a recording: its length; alike if equal."""

        name, key = "level", "hash"

        def fingerprint(self, signals, p, sample_rate):
            return signals.selectExpr("song_id", "CAST(size(samples) AS BIGINT) AS hash", "0L AS offset")

        def match(self, samples, prints, k):
            both = samples.join(prints.select("song_id", "hash"), "hash")
            return both.selectExpr("sample_id", "1 AS rank", "song_id", "1D AS score", "1L AS votes", "0L AS offset")

        def similarity(self, samples, prints, songs):
            return self.match(samples, prints, 1).selectExpr("sample_id", "song_id", "score AS similarity")

    algorithms.register(Level())
    try:
        with pytest.raises(ValueError):
            algorithms.register(Level())
        rows = [(n, tune(1, s).tolist(), None) for n, s in (("a", 1), ("b", 2))]
        built = Library.build(spark.createDataFrame(rows, "name string, samples array<double>, error string"), Params(algo="level"))
        clip = spark.createDataFrame([(0, tune(9, 2).tolist())], "sample_id long, samples array<double>")
        assert [r.name for r in built.match(clip).collect()] == ["b"]
    finally:
        del algorithms._KNOWN["level"]
        params.ALGORITHMS.remove("level")
    with pytest.raises(ValueError):
        algorithms.algorithm("level")


@pytest.mark.parametrize("algo", ["constellation", "subband"])
def test_parts_of_the_format_equal_one_file(spark, tmp_path, algo):
    rows = [(f"s{i}", tune(i, 1).tolist(), None) for i in range(3)]
    built = Library.build(spark.createDataFrame(rows, "name string, samples array<double>, error string"), Params(algo=algo))
    built.write_packed(str(tmp_path / "parts"))
    (tmp_path / "one.bin").write_bytes(b"".join(built.export()))
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "parts").glob("part-*")))
    assert whole == (tmp_path / "one.bin").read_bytes()
    rows = lambda x: sorted(map(tuple, x.songs.join(x.prints, "song_id").select("song_id", "name", *sorted(c for c in x.prints.columns if c != "song_id")).collect()))
    assert rows(import_library(spark, str(tmp_path / "parts"))) == rows(import_library(spark, str(tmp_path / "one.bin"))) == rows(built)


def test_server_is_up_before_its_library_and_drains(spark, tmp_path):
    import json
    import threading
    import urllib.error
    import urllib.request

    from tessitura.serve import Service, server

    one_song(spark, "a", 1).save(str(tmp_path / "lib"))
    service = Service(spark)
    web = server(service, port=0)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{web.server_address[1]}"

    def get(path):
        try:
            with urllib.request.urlopen(url + path, timeout=20) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    assert get("/healthz")[0] == 200 and get("/readyz")[0] == 503
    service.load_later(str(tmp_path / "missing")).join(60)
    status, body = get("/readyz")
    assert status == 503 and json.loads(body)["error"]
    service.load_later(str(tmp_path / "lib")).join(60)
    assert get("/readyz")[0] == 200 and "# HELP process_uptime_seconds" in get("/metrics")[1]
    assert web.drain(10)
    service.close()
    assert service.library is None
