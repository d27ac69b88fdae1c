import random
import struct

import numpy as np
import pytest

from tessitura.sources.wav import WavError, decode, decoded, encode, encoded, read_directory


def wav(depth, body, tag=1, data=b"data", size=None, fmt=16):
    head = struct.pack("<HHIIHH", tag, 1, 8000, 8000 * depth // 8, depth // 8, depth)[:fmt]
    chunks = struct.pack("<4sI", b"fmt ", len(head)) + head + struct.pack("<4sI", data, len(body) if size is None else size) + body
    return (b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks).ljust(44, b"\0")


def test_round_trip_and_clamping():
    x = np.array([0, 0.5, -0.5, 1.5, -1.5, 0.999])
    rate, y = decode(encode(x, 44100))
    assert rate == 44100 and np.allclose(y, np.clip(x, -1, 1), atol=2 / 32768)


@pytest.mark.parametrize("depth, body, want", [
    (8, bytes([0, 128, 255]), [-1, 0, 127 / 128]), (16, struct.pack("<2h", -32768, 16384), [-1, 0.5]),
    (24, b"\x00\x00\x80\x00\x00\x40", [-1, 0.5]), (32, struct.pack("<2i", -(2**31), 2**30), [-1, 0.5]), (16, struct.pack("<h", 1) + b"x", [1 / 32768]),
])
def test_depths(depth, body, want):
    assert decode(wav(depth, body))[1].tolist() == want


@pytest.mark.parametrize("raw", [b"", b"RIFF", b"x" * 43, b"RIFX" + wav(16, b"")[4:], wav(16, b"")[:8] + b"WAVX" + wav(16, b"")[12:], wav(16, b"abcd", tag=3), wav(12, b"abcd"), wav(16, b"abcd", data=b"dato"), wav(4, b"ab"), wav(16, b"ab" * 20, fmt=14)])
def test_rejected(raw):
    with pytest.raises(WavError):
        decode(raw)


def test_no_samples_pass_before_the_depth_is_looked_at():
    assert len(decode(wav(12, b""))[1]) == 0


def test_oversized_data_chunk_is_cut():
    assert decode(wav(16, struct.pack("<2h", 1, 2), size=0xFFFFFFFF))[1].size >= 2


def test_fuzz_never_fails_otherwise():
    r = random.Random(1)
    for _ in range(500):
        raw = bytearray(encode(np.zeros(10), 8000))
        for _ in range(4):
            raw[r.randrange(len(raw))] = r.randrange(256)
        try:
            decode(bytes(raw[: r.randrange(len(raw) + 1)]))
        except WavError:
            pass


def test_directory(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(encode([0.5, -0.5], 8000))
    (tmp_path / "b.wav").write_bytes(b"nothing")
    (tmp_path / "c.WAV").write_bytes(encode([0.5], 8000))
    got = {r.name: r for r in read_directory(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.wav", "b.wav"}
    assert got["a.wav"].sample_rate == 8000 and len(got["a.wav"].samples) == 2 and got["b.wav"].error == "file too short"


def test_round_trip_in_spark(spark):
    df = spark.createDataFrame([([0.25, -0.25],)], "samples array<double>")
    r = df.select(decoded(encoded(df.samples, 8000)).alias("d")).select("d.*").first()
    assert r.error is None and np.allclose(r.samples, [0.25, -0.25], atol=2 / 32768)
