"""Streams: clips as they arrive, matched in micro-batches; request metrics over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.sources.library import Library
from tessitura.sources.wav import base_name, decoded

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def clip_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (clip, sample_rate, samples, error) of WAV files as they appear in a folder."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", "*.wav").load(path)
    return files.select(base_name(F.col("path")).alias("clip"), decoded("content").alias("d")).select("clip", "d.*")


def match_stream(clips: DataFrame, library: Library, out: str, checkpoint: str, k: int = 5):
    """Matches of each micro-batch as Parquet below ``out``; a batch that is run again replaces its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        good = batch.where("error IS NULL").select(F.xxhash64("clip").alias("sample_id"), "clip", "samples")
        matches = library.match(good.select("sample_id", "samples"), k).join(good.select("sample_id", "clip"), "sample_id")
        matches.select("clip", "rank", "name", "score", "votes", "offset").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return clips.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def request_rates(requests: DataFrame, late: str = "10 minutes", every: str = "1 minute") -> DataFrame:
    """Requests (ts, status, elapsed) counted by window and status, with a watermark for late ones."""
    return requests.withWatermark("ts", late).groupBy(F.window("ts", every), "status").agg(F.count("*").alias("requests"), F.sum("elapsed").alias("seconds"))
