"""python -m tessitura index|match|analyze|serve"""

from __future__ import annotations

import argparse
import os

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessitura.operators.fingerprint import find_peaks, spectra
from tessitura.params import ALGORITHMS, PEAK_BINS, PEAK_FRAMES, Params
from tessitura.render import picture, png
from tessitura.sources.datasource import pairs_of
from tessitura.sources.library import Library
from tessitura.sources.wav import decode, read_directory


def chirp(rate: int = 44100) -> np.ndarray:
    t = np.arange(int(1.5 * rate)) / rate
    return 0.7 * np.sin(2 * np.pi * (200 * t + 3800 * t * t / (2 * 1.5)))


def analyze(rate: int, samples: np.ndarray, params: Params) -> dict:
    """Facts of the middle three seconds; ``density`` is over the whole duration, ``slice_density`` over the slice."""
    seconds = len(samples) / rate
    keep = 3 * rate
    at = max((len(samples) - keep) // 2, 0)
    part = samples[at : at + keep] if len(samples) > keep else samples
    mags = spectra(part, params)
    peaks = find_peaks(mags, PEAK_FRAMES, PEAK_BINS)
    hashes = pairs_of(part, params)
    return {"duration": seconds, "samples": len(samples), "frames": len(mags), "bins": mags.shape[1], "peaks": len(peaks), "hashes": len(hashes), "density": len(hashes) / seconds, "slice_density": len(hashes) / (len(part) / rate)}


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="tessitura")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("index")
    p.add_argument("folder")
    p.add_argument("library")
    p.add_argument("win_size", type=int)
    p.add_argument("hop_size", type=int)
    p.add_argument("window", nargs="?", default="")
    p.add_argument("--algo", choices=ALGORITHMS, default="constellation")
    p = sub.add_parser("match")
    p.add_argument("library")
    p.add_argument("clip")
    p = sub.add_parser("analyze")
    p.add_argument("clip", nargs="?")
    p.add_argument("--out", default=".")
    p = sub.add_parser("serve")
    p.add_argument("library")
    p.add_argument("--port", type=int, default=8080)
    a = top.parse_args(argv)
    if a.command == "analyze":
        params = Params()
        if a.clip:
            with open(a.clip, "rb") as f:
                rate, samples = decode(f.read())
        else:
            rate, samples = 44100, chirp()
        for k, v in analyze(rate, samples, params).items():
            print(f"{k}: {v}")
        mags = spectra(samples[: 3 * rate], params)
        with open(os.path.join(a.out, "spectrogram.png"), "wb") as f:
            f.write(png(picture(mags, find_peaks(mags, PEAK_FRAMES, PEAK_BINS) if a.clip else None)))
        return
    spark = SparkSession.builder.appName("tessitura").getOrCreate()
    if a.command == "index":
        library = Library.build(read_directory(spark, a.folder), Params(a.win_size, a.hop_size, a.window, a.algo))
        library.save(a.library)
        for r in library.skipped.toLocalIterator():
            print(f"skipped {r.name}: {r.error}")
        print(f"indexed {library.songs.count()} songs")
    elif a.command == "match":
        library = Library.load(spark, a.library)
        with open(a.clip, "rb") as f:
            rate, samples = decode(f.read())
        clip = spark.createDataFrame([(0, samples.tolist())], "sample_id long, samples array<double>")
        for r in library.match(clip, 5, rate).orderBy(F.col("rank")).collect():  # five rows
            print(f"{r['rank']}. {r['name']}  score {r['score']:.4f}  offset {r['offset']}")
    else:
        from tessitura.serve import Service, run

        run(Service(spark), a.library, port=a.port)


if __name__ == "__main__":
    main()
