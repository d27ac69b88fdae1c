"""Libraries of fingerprints: Parquet tables, matching, and the packed binary format."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.algorithms import algorithm
from tessitura.params import BANDS, Params
from tessitura.sources.files import put_file

# Fixed values of the binary format.
MAGIC, VERSION, HEADER, MAX_SONGS, MAX_NAME = b"PRFP", 2, 32, 65_535, 65_535
WINDOW_CODES = {"": 0, "hann": 1, "hamming": 2, "bartlett": 3}
ALGORITHM_CODES = {"constellation": 0, "subband": 1}


@dataclass
class Library:
    """songs (song_id, name, num_frames), prints (hashes or frames) and the parameters they were made with."""

    params: Params
    songs: DataFrame
    prints: DataFrame
    skipped: DataFrame | None = None

    @classmethod
    def build(cls, recordings: DataFrame, params: Params, sample_rate: int = 44100) -> Library:
        """From recordings (name, samples, error): bad or short ones are skipped, ids follow the names."""
        why = F.when(F.col("error").isNotNull(), F.col("error")).when(F.size("samples") < params.win_size + params.hop_size, F.lit("signal too short"))
        judged = recordings.withColumn("why", why)
        fine = judged.where("why IS NULL").withColumn("mark", F.xxhash64("samples"))
        # names alone go through the one task that numbers them; equal names are told apart by a hash of their samples
        order = F.row_number().over(Window.orderBy("name", "mark", "copy")) - 1
        copies = fine.groupBy("name", "mark").agg(F.count("*").alias("n")).select("name", "mark", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
        ids = copies.select("name", "mark", "copy", order.cast("long").alias("song_id"))
        good = fine.groupBy("name", "mark").agg(F.first("samples").alias("samples")).join(ids, ["name", "mark"]).select("song_id", "name", "samples")
        frames = F.floor((F.size("samples") - params.win_size) / params.hop_size)
        songs = good.select("song_id", "name", frames.cast("long").alias("num_frames"))
        prints = algorithm(params.algo).fingerprint(good, params, sample_rate)
        return cls(params, songs, prints, judged.where("why IS NOT NULL").select("name", F.col("why").alias("error")))

    def save(self, path: str) -> None:
        """Parquet tables; the prints are dealt and sorted by their key, so a match reads few row groups."""
        spark = self.songs.sparkSession
        key = algorithm(self.params.algo).key
        self.prints.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/prints")
        self.songs.write.mode("overwrite").parquet(f"{path}/songs")
        spark.createDataFrame([(json.dumps(self.params.row()),)], "params string").coalesce(1).write.mode("overwrite").text(f"{path}/params")

    def save_bucketed(self, name: str, buckets: int = 64) -> None:
        """The prints as a table bucketed by key: matches join it without shuffling it."""
        key = algorithm(self.params.algo).key
        self.prints.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Library:
        params = Params(**json.loads(spark.read.text(f"{path}/params").first()[0]))
        return cls(params, spark.read.parquet(f"{path}/songs"), spark.read.parquet(f"{path}/prints"))

    def append(self, other: Library) -> Library:
        """Both libraries' songs, the other's ids after the own."""
        if other.params != self.params:
            raise ValueError("the libraries were made with other parameters")
        last = self.songs.agg(F.max("song_id")).first()[0]
        first = 0 if last is None else last + 1
        moved = lambda df: df.withColumn("song_id", F.col("song_id") + first)
        return Library(self.params, self.songs.unionByName(moved(other.songs)), self.prints.unionByName(moved(other.prints)))

    def fingerprint(self, clips: DataFrame, sample_rate: int = 44100) -> DataFrame:
        """Prints of clips (sample_id, samples), keyed by sample_id."""
        named = clips.select(F.col("sample_id").alias("song_id"), "samples")
        return algorithm(self.params.algo).fingerprint(named, self.params, sample_rate).withColumnRenamed("song_id", "sample_id")

    def match(self, clips: DataFrame, k: int = 5, sample_rate: int = 44100) -> DataFrame:
        """sample_id, rank, name, score, votes, offset of clips (sample_id, samples), all in one plan."""
        return self.match_prints(self.fingerprint(clips, sample_rate), k)

    def match_prints(self, prints: DataFrame, k: int = 5) -> DataFrame:
        found = algorithm(self.params.algo).match(prints, self.prints, k)
        return found.join(self.songs.select("song_id", "name"), "song_id").select("sample_id", "rank", "name", "score", "votes", F.col("offset").cast("long").alias("offset"))

    def similarity(self, prints: DataFrame) -> DataFrame:
        """sample_id, song_id, similarity, as the algorithm has it."""
        return algorithm(self.params.algo).similarity(prints, self.prints, self.songs)

    def stats(self) -> DataFrame:
        n = self.songs.agg(F.count("*").alias("songs"), F.coalesce(F.sum("num_frames"), F.lit(0)).alias("frames"))
        return n.crossJoin(self.prints.agg(F.count("*").alias("prints"))).select("*", *(F.lit(v).alias(k) for k, v in self.params.row().items()))  # one row each

    # the binary format ---------------------------------------------------
    def packed(self) -> DataFrame:
        """song_id, entry binary: each song as the format has it, made by the tasks."""
        spark, p = self.songs.sparkSession, self.params
        if self.songs.where(f"octet_length(name) > {MAX_NAME}").limit(1).count():
            raise ValueError("a name is too long for the format")
        fields = ("offset", "hash") if p.algo == "constellation" else ("frame", "bits")
        rows = self.prints.groupBy("song_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("x"))
        rows = self.songs.join(rows, "song_id", "left").select("song_id", "name", "num_frames", F.col(f"x.{fields[0]}").alias("at"), F.col(f"x.{fields[1]}").alias("value"))

        def run(frames):
            import pandas as pd

            for b in frames:
                out = [pack_song(p.algo, r.name, r.num_frames, r.at, r.value) for r in b.itertuples(index=False)]
                yield pd.DataFrame({"song_id": b["song_id"], "entry": out})

        return rows.select("song_id", F.col("name"), "num_frames", "at", "value").mapInPandas(run, "song_id long, entry binary")

    def write_packed(self, path: str) -> None:
        """A folder of the format's parts: ``header``, and one file for each range of songs, in order of their names."""
        n = self.songs.count()
        if n > MAX_SONGS:
            raise ValueError(f"the format holds {MAX_SONGS} songs, not {n}")
        put_file(f"{path}/part-header", pack_header(self.params, n))

        def put(part, rows):
            raw = b"".join(bytes(r.entry) for r in rows)
            if raw:
                put_file(f"{path}/part-songs-{part:06d}", raw)
            return iter(())

        self.packed().repartitionByRange("song_id").sortWithinPartitions("song_id").rdd.mapPartitionsWithIndex(put).count()  # files in order need the partition's number

    def export(self) -> Iterator[bytes]:
        """The library in the packed format, header first, one song at a time."""
        n = self.songs.count()
        if n > MAX_SONGS:
            raise ValueError(f"the format holds {MAX_SONGS} songs, not {n}")
        yield pack_header(self.params, n)
        for r in self.packed().orderBy("song_id").toLocalIterator():
            yield bytes(r.entry)


def pack_header(p: Params, n: int) -> bytes:
    return struct.pack("<4sIIIIBB", MAGIC, VERSION, n, p.win_size, p.hop_size, WINDOW_CODES[p.window_func], ALGORITHM_CODES[p.algo]).ljust(HEADER, b"\0")


def pack_song(algo: str, name: str, num_frames: int, at, value) -> bytes:
    """Name, frames and prints of one song; no prints are null."""
    raw, n = name.encode(), 0 if at is None else len(at)
    if algo == "constellation":
        data = np.stack((np.asarray(value, np.int64), np.asarray(at, np.int64)), axis=1).astype("<u4").tobytes() if n else b""
    else:
        data = ((np.asarray(value, np.int64)[:, None] >> np.arange(BANDS - 1)) & 1).astype(np.uint8).tobytes() if n else b""
    return struct.pack("<H", len(raw)) + raw + struct.pack("<II", num_frames, len(data)) + data


def parse_header(raw: bytes) -> tuple[Params, int]:
    """Parameters and number of songs."""
    if len(raw) < HEADER:
        raise ValueError("library too short")
    magic, version, n, win, hop, window, algo = struct.unpack_from("<4sIIIIBB", raw)
    if magic != MAGIC:
        raise ValueError("not a library")
    if version != VERSION:
        raise ValueError(f"unsupported version {version}")
    names = {v: k for k, v in WINDOW_CODES.items()}
    if window not in names:
        raise ValueError(f"unknown window code {window}")
    return Params(win, hop, names[window], "subband" if algo == 1 else "constellation"), n


def parse_songs(raw: bytes, at: int, algo: str, n: int | None = None) -> Iterator[tuple[str, int, np.ndarray]]:
    """(name, frames, array) of ``n`` songs from a place on, or of all; every length is checked against the bytes."""

    def take(size: int) -> bytes:
        nonlocal at
        if at + size > len(raw):
            raise ValueError("library cut off")
        at += size
        return raw[at - size : at]

    while n is None and at < len(raw) or n:
        n = None if n is None else n - 1
        name = take(struct.unpack("<H", take(2))[0]).decode()
        frames, size = struct.unpack("<II", take(8))
        data = take(size)
        if algo == "constellation":
            yield name, frames, np.frombuffer(data[: size // 8 * 8], "<u4").reshape(-1, 2)
        else:
            yield name, size // (BANDS - 1), np.frombuffer(data[: size // (BANDS - 1) * (BANDS - 1)], np.uint8).reshape(-1, BANDS - 1)


def parse(raw: bytes) -> tuple[Params, list[tuple[str, int, np.ndarray]]]:
    """Parameters and songs of a whole file."""
    params, n = parse_header(raw)
    return params, list(parse_songs(raw, HEADER, params.algo, n))


def import_library(spark: SparkSession, path: str) -> Library:
    """A packed library file, or a folder of parts as ``write_packed`` leaves it; each file is opened in a task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    head = files.where(F.substring("content", 1, 4) == F.lit(MAGIC)).select(F.substring("content", 1, HEADER).alias("head")).first()
    if head is None:
        raise ValueError("not a library")
    params, n_songs = parse_header(bytes(head["head"]))
    pair = params.algo == "constellation"

    def run(batches):
        import pandas as pd

        for b in batches:
            for place, raw in zip(b["path"], b["content"], strict=True):
                raw = bytes(raw)
                whole = raw[:4] == MAGIC
                if whole and len(raw) == HEADER:
                    continue
                for i, (name, frames, x) in enumerate(parse_songs(raw, HEADER if whole else 0, params.algo, n_songs if whole else None)):
                    if pair:
                        at, value = x[:, 1].astype(np.int64), x[:, 0].astype(np.int64)
                    else:
                        at, value = np.arange(len(x)), x.astype(np.int64) @ (np.int64(1) << np.arange(BANDS - 1))
                    yield pd.DataFrame({"path": place, "i": i, "name": name, "num_frames": frames, "value": [value], "at": [at]})

    rows = files.mapInPandas(run, "path string, i long, name string, num_frames long, value array<long>, at array<long>")
    counts = rows.groupBy("path").agg(F.count("*").alias("n"))  # one row for each file
    first = counts.select("path", (F.sum("n").over(Window.orderBy("path")) - F.col("n")).alias("first"))
    rows = rows.join(first, "path").withColumn("song_id", F.col("first") + F.col("i"))
    flat = rows.select("song_id", F.explode(F.arrays_zip("value", "at")).alias("x")).select("song_id", "x.value", "x.at")
    prints = flat.select("song_id", F.col("value").alias("hash"), F.col("at").alias("offset")) if pair else flat.select("song_id", F.col("at").cast("int").alias("frame"), F.col("value").alias("bits"))
    return Library(params, rows.select("song_id", "name", "num_frames"), prints)
