"""``spark.read.format("wav")`` and SQL table functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

from tessitura.operators.fingerprint import find_peaks, spectra
from tessitura.params import FAN_OUT, MAX_BIN_GAP, MAX_GAP, MIN_GAP, Params
from tessitura.sources.files import get_file, listed
from tessitura.sources.wav import decode


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WavReader(DataSourceReader):
    """One partition for each file of a folder that all executors see."""

    def __init__(self, options):
        self.folder = options["path"]

    def partitions(self):
        return [File(f) for f in listed(self.folder, ".wav")]

    def read(self, partition) -> Iterator[tuple]:
        name = partition.path.rsplit("/", 1)[-1]
        try:
            rate, samples = decode(get_file(partition.path))
            yield name, rate, samples.tolist(), None
        except ValueError as e:
            yield name, None, None, str(e)


class WavSource(DataSource):
    @classmethod
    def name(cls):
        return "wav"

    def schema(self):
        return "name string, sample_rate int, samples array<double>, error string"

    def reader(self, schema):
        return WavReader(self.options)


def pairs_of(samples, params: Params) -> list[tuple[int, int]]:
    """(hash, offset) of one signal, in plain Python: for table functions and as a model in tests."""
    import numpy as np

    found = find_peaks(spectra(np.asarray(samples, float), params), params.peak_frames, params.peak_bins, params.peak_floor).tolist()
    out = []
    for i, (f, b) in enumerate(found):
        near = [(t, c) for t, c in found[i + 1 :] if MIN_GAP <= t - f <= MAX_GAP and abs(c - b) <= MAX_BIN_GAP][:FAN_OUT]
        out.extend(((b & 1023) | (c & 1023) << 10 | ((t - f) & 4095) << 20, f) for t, c in near)
    return out


@udtf(returnType="hash long, offset long")
class FingerprintWav:
    """``SELECT ... FROM files, LATERAL fingerprint_wav(content)``."""

    def eval(self, content: bytes):
        _, samples = decode(content)
        yield from pairs_of(samples, Params())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WavSource)
    spark.udtf.register("fingerprint_wav", FingerprintWav)
