"""Packing along a space-filling curve: like documents share sequences, almost nothing is padded."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import NULL_ID, PLAIN_WORD, Words, id_or_least, memory_returned, mix, ship, text_chunks
from faultline.llm.tokens import default_vocabulary, encoder, text_slices

BUCKETS, AXES, BITS = 256, 3, 10
OUT_IDS = 1 << 19
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_length long, ids binary"
#: Fixed signs that take a hashed vector of BUCKETS counts to AXES coordinates.
_PROJECTION = np.where(mix(np.arange(1, BUCKETS * AXES + 1, dtype=np.uint64)) >> np.uint64(63), 1.0, -1.0).reshape(BUCKETS, AXES)


def hilbert_key(axes: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows) with ``bits`` bits per axis, by Skilling's transform."""
    x = axes.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(high, x[:, 0] ^ p, x[:, 0] ^ swap)
            x[:, i] ^= swap if i else 0
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[:, n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def curve_keys(texts: pa.Array) -> np.ndarray:
    """Hilbert key of each text's hashed word vector; a text without words lies at the centre."""
    out = np.zeros(len(texts), np.int64)
    for row, n, data, offsets in text_chunks(texts):
        w = Words(data, offsets, PLAIN_WORD)
        bucket = (w.hash % np.uint64(BUCKETS)).astype(np.int64)
        sign = np.where(w.hash >> np.uint64(63), 1.0, -1.0)
        vector = np.bincount(w.doc * BUCKETS + bucket, weights=sign, minlength=n * BUCKETS).reshape(n, BUCKETS)
        norm = np.sqrt((vector * vector).sum(axis=1, keepdims=True))
        place = vector @ _PROJECTION / np.maximum(norm, 1e-9)
        cell = (1 / (1 + np.exp(-1.702 * place)) * (1 << BITS)).astype(np.int64).clip(0, (1 << BITS) - 1)
        out[row : row + n] = hilbert_key(cell, BITS)
    return out


class _Packer:
    """Fills sequences with a stream of documents; holds the open sequence only."""

    def __init__(self, first: int, size: int):
        self.next, self.size = first, size
        self.open: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        self.used = 0
        self.done: list[tuple] = []

    def add(self, key, ids: np.ndarray) -> None:
        at, n = 0, len(ids)
        while at < n:
            take = min(n - at, self.size - self.used)
            self.open.append((key, at, ids[at : at + take], n))
            self.used += take
            at += take
            if self.used == self.size:
                self._close(self.size)

    def _close(self, length: int) -> None:
        offset = 0
        for key, start, ids, n in self.open:
            self.done.append((key, start, len(ids), n, self.next, offset, length, ids))
            offset += len(ids)
        self.open, self.used, self.next = [], 0, self.next + 1

    def finish(self) -> None:
        """Cut the rest into sequences whose lengths are powers of two: none is padded."""
        rest, self.open, used, self.used = self.open, [], self.used, 0
        i, cut = 0, 0
        while used:
            want = length = 1 << (used.bit_length() - 1)
            while want:
                key, start, ids, n = rest[i]
                take = min(want, len(ids) - cut)
                self.open.append((key, start + cut, ids[cut : cut + take], n))
                want, cut = want - take, cut + take
                if cut == len(ids):
                    i, cut = i + 1, 0
            self._close(length)
            used -= length

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.done))
        ids = np.concatenate(cols[7]).astype("<u4")
        cuts = np.concatenate([[0], np.cumsum(np.array(cols[2], np.int64))]) * 4
        blob = pa.Array.from_buffers(pa.large_binary(), len(self.done), [None, pa.py_buffer(cuts), pa.py_buffer(ids)]).cast(pa.binary())
        self.done = []
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:7]), blob], names=names)


def pack(docs: DataFrame, *, vocabulary: str | None = None, end_id: int = 1, size: int = 2048) -> DataFrame:
    """Token sequences of at most ``size`` ids, one row per piece of a document.

    Documents are ordered by (Hilbert key of the hashed word vector, doc_id, text)
    and laid end to end within each range of the curve; a document is cut where a
    sequence fills.  The rest of a range is cut into sequences of a power of two,
    so no id of padding is needed.  Columns as in ``SCHEMA``; ``ids`` are
    little-endian unsigned 32-bit.  A null text is empty and still holds
    ``end_id``; a null doc_id stays null; rows that repeat a doc_id stay
    documents of their own.  Other columns are not read.  An empty table gives no
    sequences.
    """
    ship(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    @F.arrow_udf("long")
    def key(texts: pa.Array) -> pa.Array:
        out = pa.array(curve_keys(texts))
        memory_returned()
        return out

    def fill(batches):
        coder = encoder(path)
        packer = _Packer(TaskContext.get().partitionId() << 40, size)
        held = 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for row, texts in text_slices(batch.column(1)):
                ids, cuts = coder.encode(texts, end_id)
                for k in range(len(texts)):
                    name = names[row + k]
                    packer.add(None if name == NULL_ID else name, ids[cuts[k] : cuts[k + 1]])
                held += len(ids)
                if held >= OUT_IDS and packer.done:
                    yield packer.batch()
                    held = 0
            memory_returned()
        packer.finish()
        if packer.done:
            yield packer.batch()

    rows = docs.select(id_or_least().alias("doc"), F.col("text").cast("string").alias("text"))
    keyed = rows.select(key("text").alias("key"), "doc", "text")
    ordered = keyed.repartitionByRange("key", "doc").sortWithinPartitions("key", "doc", "text")
    return ordered.select("doc", "text").mapInArrow(fill, SCHEMA)
