"""Shared helpers of the training-data operators.

Text is handled as UTF-8 bytes in NumPy.  A *word* is a maximal run of bytes
other than space and 0x09-0x0D; multi-byte characters never contain those
bytes, so this equals ``[^\\x20\\x09-\\x0D]+`` over characters.  Hashes are 64-bit
sums of random table entries times powers of an odd constant, finished with a
mixing step; they are the same in every process and on every machine.
"""

from __future__ import annotations

import contextlib
import gc
import math
import os
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir

PIECE_BYTES = 2 << 20  # text handled at once inside a task
SMALL_PIECE = 512 << 10  # the same where nothing is gained by larger ones: tables and arrays of a worker grow with it
U64 = np.uint64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; also tells Python workers where this package lies."""
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [home, paths]))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def cut_measured(df: DataFrame) -> DataFrame:
    """``cut`` for tables that are made again and again from themselves.

    A checkpoint keeps Spark's estimate of its size, and a join's estimate is
    the product of its sides: after some rounds of joins a number of millions
    of digits, which fills the driver's memory and takes minutes to plan.  A
    stored table has its real size.
    """
    stored = df.persist(StorageLevel.DISK_ONLY)
    stored.count()
    out = cut(stored.select("*"))
    stored.unpersist()
    return out


def tasks_for(spark: SparkSession, shares: float) -> int:
    """Number of tasks for so many shares of work, two for each core at least.

    ``coalesce`` to it keeps small written tables from having as many
    partitions as the shuffle: each task of a step leaves files (a disk block
    each, however short), and the driver remembers each.
    """
    return max(2 * spark.sparkContext.defaultParallelism, math.ceil(shares))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of steps that nothing refers to any more.

    The cleaner follows the driver's garbage collector, which may otherwise
    not run before the next large shuffle is written.  Py4J drops the plans of
    collected Python objects in a thread that looks for them once a second,
    and events that wait for a listener still hold theirs.
    """
    gc.collect()
    time.sleep(1.2)
    for _ in range(2):  # what the last event still held the first time goes the second time
        with contextlib.suppress(Py4JJavaError):  # not empty after ten seconds
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column over all rows (one aggregate over the scan)."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()["b"])


def buckets_for(amount: int, per_bucket: int, least: int = 24) -> int:
    """Number of buckets so that each holds about ``per_bucket``; grows with the data."""
    return max(least, -(-int(amount) // int(per_bucket)))


# -- hashing --------------------------------------------------------------

def _table(seed: int, n: int = 256) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection on 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """Powers of an odd constant and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = U64(base | 1), U64(pow(base | 1, -1, 1 << 64))
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n + n // 8, 1 << 16)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, self.base))])
                self.down = np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, self.inverse))])
            if size > 1 << 23:  # one very long text: do not keep its tables
                up, down, self.up, self.down = self.up, self.down, np.ones(1, U64), np.ones(1, U64)
                return up[:n], down[:n]
        return self.up[:n], self.down[:n]


class Hasher:
    """Word hashes of a byte buffer, and hashes of windows of consecutive words."""

    def __init__(self, seed: int):
        self.table = _table(seed)
        self.bytes_powers = Powers(int(_table(seed + 1, 1)[0]))
        self.word_powers = Powers(int(_table(seed + 2, 1)[0]))

    def words(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = self.bytes_powers.upto(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, U64)
        np.cumsum(self.table[buf] * up[:-1], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))

    def windows(self, words: np.ndarray, width: int) -> np.ndarray:
        """Hash of ``words[i:i+width]`` for every i (also across texts: callers mask those)."""
        n = len(words) - width + 1
        if n <= 0:
            return np.zeros(0, U64)
        up, down = self.word_powers.upto(len(words) + 1)
        sums = np.zeros(len(words) + 1, U64)
        np.cumsum(words * up[:-1], out=sums[1:])
        return mix((sums[width:] - sums[:n]) * down[:n])


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Piece:
    """Some whole texts: bytes, word bounds and the first word of each text."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets = buf, offsets
        word = ~_SEPARATOR[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[offsets] = True  # texts end here even without white space
        before = np.concatenate([[False], word[:-1]]) if len(buf) else word
        after = np.concatenate([word[1:], [False]]) if len(buf) else word
        self.starts = np.flatnonzero(word & (~before | edge[:-1]))
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)  # per text, and the total at the end
        self.counts = np.diff(self.first)

    def windows_inside(self, width: int) -> np.ndarray:
        """True for each i < n_words-width+1 whose window lies in one text."""
        n = len(self.starts) - width + 1
        if n <= 0:
            return np.zeros(0, bool)
        doc = np.repeat(np.arange(len(self.counts)), self.counts)
        return doc[:n] == doc[width - 1:]


def utf8_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = column.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    off = np.frombuffer(offsets, np.int64)[wide.offset: wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0]: off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes; a longer text stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def pieces(buf: np.ndarray, offsets: np.ndarray, lower: bool = False, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, Piece]]:
    for a, b in slices(offsets, limit):
        part = buf[offsets[a]: offsets[b]]
        yield a, b, Piece(LOWER[part] if lower else part, offsets[a: b + 1] - offsets[a])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(s, s + n)`` for each pair."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.cumsum(lengths) - lengths
    return np.repeat(starts.astype(np.int64) - skip, lengths) + np.arange(total)
