"""Driver tables read as signals, spectra and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.operators.subband import subband_frames
from tessitura.params import BANDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as ten signals: the values of users alike modulo 10, in order of time."""
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("signal_id"), "ts", "event_id", F.col("value").alias("sample"))
    order = Window.partitionBy("signal_id").orderBy("ts", "event_id")
    return events.select("signal_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "sample")


def embedding_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as spectra: one signal a label, one frame a vector (signal_id, frame, mags)."""
    order = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("signal_id"), (F.row_number().over(order) - 1).alias("frame"), F.col("embedding").cast("array<double>").alias("mags"))


def embedding_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 numbers of each vector as band energies, to 39 bits (signal_id, frame, bits)."""
    return subband_frames(embedding_frames(spark, sf_dir).select("signal_id", "frame", F.slice("mags", 1, BANDS).alias("energies")))
