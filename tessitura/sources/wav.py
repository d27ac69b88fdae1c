"""PCM WAV files: decoding, encoding, and reading through Spark's binaryFile source."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.sources.files import put_file

DECODED = T.StructType().add("sample_rate", T.IntegerType()).add("samples", T.ArrayType(T.DoubleType())).add("error", T.StringType())


class WavError(ValueError):
    pass


def chunks(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(id, body) of each chunk; a body longer than the file is cut, odd sizes are padded."""
    at = 12
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        body = raw[at + 8 : at + 8 + size]
        yield name, body
        at += 8 + len(body) + (len(body) & 1)


def decode(raw: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and samples in [-1, 1).  Channels stay interleaved, as one stream."""
    raw = bytes(raw)
    if len(raw) < 44:
        raise WavError("file too short")
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise WavError("not a RIFF/WAVE file")
    rate = depth = 0
    data = None
    for name, body in chunks(raw):
        if name == b"fmt ":
            if len(body) < 16:
                raise WavError("fmt chunk too short")
            if struct.unpack_from("<H", body)[0] != 1:
                raise WavError("only PCM is supported")
            rate, depth = struct.unpack_from("<I", body, 4)[0], struct.unpack_from("<H", body, 14)[0]
        elif name == b"data":
            data = body
    if data is None:
        raise WavError("no data chunk")
    width = depth // 8
    if width == 0:
        raise WavError("no bits per sample")
    n = len(data) // width
    if n == 0:
        return rate, np.empty(0)
    data = data[: n * width]
    if depth == 8:
        return rate, (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    if depth == 16:
        return rate, np.frombuffer(data, "<i2") / 32768
    if depth == 24:
        wide = np.zeros((n, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(data, np.uint8).reshape(n, 3)
        return rate, (wide.view("<i4").ravel() >> 8) / 8388608
    if depth == 32:
        return rate, np.frombuffer(data, "<i4") / 2147483648
    raise WavError(f"unsupported bit depth {depth}")


def encode(samples, sample_rate: int, channels: int = 1) -> bytes:
    """16-bit PCM; values are cut to the range and toward zero."""
    pcm = np.clip(np.trunc(np.asarray(samples, float) * 32767), -32768, 32767).astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(pcm), b"WAVE", b"fmt ", 16, 1, channels, sample_rate, sample_rate * channels * 2, channels * 2, 16, b"data", len(pcm))
    return head + pcm


@F.pandas_udf(DECODED)
def decoded(content: pd.Series) -> pd.DataFrame:
    """struct<sample_rate, samples, error> of WAV bytes; error is null where all is well."""
    rows = []
    for raw in content:
        try:
            rate, samples = decode(raw if raw is not None else b"")
            rows.append((rate, samples, None))
        except (WavError, struct.error) as e:
            rows.append((None, None, str(e)))
    return pd.DataFrame(rows, columns=["sample_rate", "samples", "error"]).astype({"sample_rate": "Int32"})


def encoded(samples: Column, sample_rate: int, channels: int = 1) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: encode(x, sample_rate, channels))

    return run(samples)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """name, sample_rate, samples, error of the ``*.wav`` files right in a folder; bad files keep their error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "false").load(path)
    return files.select(base_name(F.col("path")).alias("name"), decoded("content").alias("d")).select("name", "d.*")


def write_directory(df: DataFrame, path: str, sample_rate: int) -> None:
    """One file for each row (name, samples), written by the tasks below a folder (a path or URI that they share)."""

    def put(rows):
        for r in rows:
            put_file(f"{path}/{r.name}", encode(r.samples, sample_rate))

    df.select("name", "samples").foreachPartition(put)
