"""Helpers of the corpus operators: shared folders, Arrow text chunks, vectorised word hashes."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import dropped, ensure_checkpoint_dir, shuffles_freed  # noqa: F401

_SHIPPED = "faultline.shipped"


def ship(spark: SparkSession) -> None:
    """Give the executors this package as a zip, once per context: they need not have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "faultline_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(target)
    setattr(sc, _SHIPPED, True)


def memory_returned() -> None:
    """Give back what Arrow and the C library keep for reuse: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


CHUNK_BYTES = 2 << 20
NULL_ID = -(1 << 63)


def workspace(spark: SparkSession, label: str) -> str:
    """A fresh folder below the checkpoint folder that all executors share."""
    ensure_checkpoint_dir(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = workspace(spark, label)
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_or_least(column: str = "doc_id") -> Column:
    """Null ids take part as the smallest id there is."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) over a string column, some ``limit`` bytes at a time; null is empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        to = min(to, n)
        yield row, to - row, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


_MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (the finaliser of a split-mix generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base & _MASK, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_MULTIPLIER), _Powers(0xD6E8FEB86659FD93)


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, powers: _Powers) -> np.ndarray:
    """Position-free polynomial hash of ``values[start:end]`` for many spans, from one prefix sum."""
    up, down = powers.to(len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


class Words:
    """Words of a chunk of texts: byte spans, document of each word, 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray | None = None):
        inside = is_word[data]
        if len(data):
            before = np.empty(len(data), bool)
            before[0] = False
            before[1:] = inside[:-1]
            edges = offsets[(offsets > 0) & (offsets < len(data))]
            before[edges] = False
            after = np.empty(len(data), bool)
            after[-1] = False
            after[:-1] = inside[1:]
            after[edges - 1] = False
            self.start = np.flatnonzero(inside & ~before)
            self.end = np.flatnonzero(inside & ~after) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.bounds = np.searchsorted(self.start, offsets)  # first word of each document
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.left = self.bounds[1:][self.doc] - np.arange(len(self.start))  # words from here to the document's end
        if fold is not None:
            data = fold[data]
        self.hash = spans_hash(_BYTE_CODE[data], self.start, self.end, _BYTES)

    def __len__(self) -> int:
        return len(self.start)

    def window(self, length: int) -> np.ndarray:
        """Hash of the ``length`` words from each word on, built by joining halves; ends may cross documents."""
        n = len(self) - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        done, out, block, size = 0, None, self.hash, 1
        rest = length
        while rest:
            if rest & 1:
                part = block[done:]
                out = part if out is None else join_hashes(out[: len(part)], part)
                done += size
            rest >>= 1
            if rest:
                block = join_hashes(block[:-size], block[size:])
                size *= 2
        return out[:n]


def join_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0xC2B2AE3D27D4EB4F) + (b[: len(a)] if len(b) > len(a) else b))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the least of each ``width`` neighbours, the leftmost of equals, by doubling."""

    def better(a, b):
        return np.where(values[b] < values[a], b, a)

    best, size = np.arange(len(values)), 1
    while size * 2 <= width:
        best = better(best[:-size], best[size:])
        size *= 2
    if size < width:
        best = better(best[: len(values) - width + 1], best[width - size :])
    return best


#: Bytes of the words [^\x20\x09-\x0D]+.
PLAIN_WORD = np.ones(256, bool)
PLAIN_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ and A-Z, which are folded first.
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
FOLD_ASCII = np.arange(256, dtype=np.uint8)
FOLD_ASCII[0x41:0x5B] += 0x20
#: The first, as a Spark and Java character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
