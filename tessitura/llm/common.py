"""Helpers that the operators share: tables, the shared folder, tokens."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: space and \x09 to \x0D.
SPACES = " \t\n\x0b\x0c\r"
WORD_SQL = r"[^\x20\x09-\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a temporary
    folder stands in for it in local mode, and any other master is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it held, not the
    stages before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")  # the written table is all that is read later, so the shuffle files can go at once
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``written`` made and that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving freed memory back to the system as the task ends.

    Workers wait for their next task with all that their allocators keep, hundreds of MB
    after a scan of texts, and the JVM beside them has that much less.
    """

    def then_free(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return then_free


def parts_for(df: DataFrame, part_bytes: int) -> int:
    """Partitions of about ``part_bytes`` of input by the planner's estimate, and no fewer than the session has."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, -(-estimate // part_bytes)) if estimate < 2**54 else least  # rows that come from no file count as 2 ** 63 bytes, or a share of that


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with as many underscores before it as it takes to clash with no column."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def number_of(df: DataFrame, key: str) -> Column:
    """A long for each key: integers as they are, keys of other types by a 64-bit hash; null stays null."""
    if df.schema[key].dataType.typeName() in ("long", "integer", "short", "byte"):
        return F.col(quoted(key)).cast("long")
    return F.when(F.col(quoted(key)).isNotNull(), F.xxhash64(quoted(key)))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_strings(words: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct strings, the same in every process."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


class Tokens:
    """The words of a batch of texts: ``ids`` into ``words``, ``starts`` per text.

    Null texts have no words.  ``lower`` maps A-Z to a-z and nothing else.
    """

    def __init__(self, texts: pa.Array | pa.ChunkedArray, lower: bool = True):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if lower:
            texts = _ascii_lower(texts)
        parts = pc.split_pattern_regex(texts, r"[\x20\x09-\x0D]+")
        flat = pc.list_flatten(parts)
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        coded = flat.dictionary_encode()
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = coded.dictionary
        empty = pc.index(words, pa.scalar("", words.type)).as_py()
        if empty >= 0:  # leading and trailing white space, empty texts
            there = ids != empty
            before = np.concatenate(([0], np.cumsum(there)))
            offsets, ids = before[offsets], ids[there]
        self.ids, self.words, self.starts = ids, words, offsets

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.starts)


_UPPER = bytes(range(65, 91))
_LOWER_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _ascii_lower(texts: pa.Array) -> pa.Array:
    """Lower-case A-Z in the UTF-8 bytes of a large_string array."""
    _, offsets, data = texts.buffers()
    if data is None:
        return texts
    raw = data.to_pybytes().translate(_LOWER_TABLE)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(raw)], 0, texts.offset)
