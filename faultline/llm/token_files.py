"""Token-id shards: ids end to end, document boundaries and ids in Elias-Fano form.

File: the ids (unsigned, little-endian, 16 bits if the vocabulary allows it, else
32), the boundary section, the document-id section, a footer.  A section holds
the low bits of its n values packed at ``l`` bits each, a bitmap in which value
i sets bit ``(value >> l) + i``, and for every 512th set bit its place, as
unsigned 32-bit integers.  ``select`` finds any boundary from the sampled place;
no table of 64-bit offsets exists on disk.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.files import attempt_name, locate
from faultline.llm.shared import NULL_ID, id_or_least, ship, workspace, written
from faultline.llm.tokens import default_vocabulary, encoder, text_slices

MAGIC = b"EFTOKENS"
_FOOTER = struct.Struct("<8sIIQQqQ" + "QIQQ" * 2)
SAMPLE_EVERY = 512
OUT_BYTES = 8 << 20


class EliasFano:
    """A non-decreasing sequence of unsigned integers in about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, low_bits: int, upper_bits: int, low: np.ndarray, upper: np.ndarray, samples: np.ndarray):
        self.n, self.l, self.bits, self.low, self.upper, self.samples = n, low_bits, upper_bits, low, upper, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        l = max(0, (top // n).bit_length() - 1) if n else 0
        high = v >> np.uint64(l) if l < 64 else np.zeros(n, np.uint64)
        ones = high.astype(np.int64) + np.arange(n)
        bits = int(ones[-1]) + 1 if n else 0
        upper = np.zeros(bits, np.uint8)
        upper[ones] = 1
        shifts = np.arange(l, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        return cls(n, l, bits, low, np.packbits(upper, bitorder="little"), ones[::SAMPLE_EVERY].astype(np.uint32))

    def parts(self) -> bytes:
        return self.low.tobytes() + self.upper.tobytes() + self.samples.astype("<u4").tobytes()

    def sizes(self) -> tuple[int, int, int]:
        return (self.n * self.l + 7) // 8, (self.bits + 7) // 8, -(-self.n // SAMPLE_EVERY) * 4

    @classmethod
    def decode(cls, n: int, low_bits: int, upper_bits: int, raw: bytes) -> EliasFano:
        out = cls(n, low_bits, upper_bits, None, None, None)
        a, b, c = out.sizes()
        buf = np.frombuffer(raw, np.uint8)
        out.low, out.upper, out.samples = buf[:a], buf[a : a + b], buf[a + b : a + b + c].view("<u4")
        return out

    def _low(self, i: int) -> int:
        at, end = i * self.l, (i + 1) * self.l
        word = int.from_bytes(self.low[at // 8 : (end + 7) // 8].tobytes(), "little")
        return (word >> (at % 8)) & ((1 << self.l) - 1)

    def select(self, i: int) -> int:
        """Value i, from the sampled place before it and a scan of the bitmap."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, need = int(self.samples[i // SAMPLE_EVERY]), i % SAMPLE_EVERY
        byte = place // 8
        skip = place % 8
        while True:
            block = np.unpackbits(self.upper[byte : byte + 512], bitorder="little")[skip:]
            ones = np.flatnonzero(block)
            if need < len(ones):
                place = byte * 8 + skip + int(ones[need])
                return ((place - i) << self.l) | self._low(i)
            need -= len(ones)
            byte, skip = byte + 512, 0

    def all(self) -> np.ndarray:
        """Every value, as unsigned 64-bit integers in memory."""
        ones = np.flatnonzero(np.unpackbits(self.upper, bitorder="little", count=self.bits))
        high = (ones - np.arange(self.n)).astype(np.uint64)
        if not self.l:
            return high
        bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.l).reshape(self.n, self.l).astype(np.uint64)
        return (high << np.uint64(self.l)) | (bits << np.arange(self.l, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


class TokenShard:
    """Reader of one shard; documents by position, boundaries by ``select``."""

    def __init__(self, uri: str):
        fs, path = locate(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        f = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if f[0] != MAGIC:
            raise ValueError(f"{uri}: not a token shard")
        self.width, self.n_docs, self.n_null, self.base, self.n_ids = f[2], f[3], f[4], f[5], f[6]
        sections = []
        for at in (7, 11):
            where, low_bits, upper_bits, n = f[at : at + 4]
            probe = EliasFano(n, low_bits, upper_bits, None, None, None)
            sections.append(EliasFano.decode(n, low_bits, upper_bits, self.file.read_at(sum(probe.sizes()), where)))
        self.ends, self.names = sections

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.base + self.names.select(i - self.n_null)

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - start) * self.width, start * self.width), f"<u{self.width}")

    def doc_ids(self) -> list[int | None]:
        return [None] * self.n_null + [self.base + int(v) for v in self.names.all()]

    def close(self) -> None:
        self.file.close()


def write_shard(uri: str, encoded: Iterator[tuple[list[int], np.ndarray, np.ndarray]], width: int) -> tuple[int, int]:
    """Write one shard from (ids of documents, token ids, bounds) pieces; returns documents and ids written."""
    fs, path = locate(uri)
    names, ends, total = [], [], 0
    with fs.open_output_stream(path) as out:
        for keys, ids, cuts in encoded:
            out.write(ids.astype(f"<u{width}").tobytes())
            names += keys
            ends.append(cuts[1:] + total)
            total += len(ids)
        ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        n_null = sum(k == NULL_ID for k in names)
        base = names[n_null] if n_null < len(names) else 0
        name_set = EliasFano.encode(np.array([k - base for k in names[n_null:]], np.uint64))
        sections, at = [], total * width
        for ef in (EliasFano.encode(ends), name_set):
            raw = ef.parts()
            out.write(raw)
            sections += [at, ef.l, ef.bits, ef.n]
            at += len(raw)
        out.write(_FOOTER.pack(MAGIC, 1, width, len(names), n_null, base, total, *sections))
    return len(names), total


def write_token_files(docs: DataFrame, *, vocabulary: str | None = None, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text", folder: str | None = None) -> DataFrame:
    """Encode every whole text, write shards in ascending id order, return the manifest.

    Manifest: shard, path, n_docs, n_ids.  A null text is empty and still gets
    ``end_id``; a null id sorts first; rows that repeat an id stay rows of their
    own, ordered by text.  Other columns are not read.  An empty table gives an
    empty manifest.
    """
    ship(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    folder = folder or workspace(docs.sparkSession, "tokens")

    def write(batches):
        coder = encoder(path)
        size = coder.tokenizer.get_vocab_size()
        width = 2 if max(size, end_id + 1) <= 1 << 16 else 4

        def encoded():
            for batch in batches:
                keys = batch.column(0).to_pylist()
                for row, texts in text_slices(batch.column(1)):
                    yield keys[row : row + len(texts)], *coder.encode(texts, end_id)

        pieces = encoded()
        first = next(pieces, None)
        if first is None:
            return
        shard = TaskContext.get().partitionId()
        uri = attempt_name(folder, f"shard-{shard:06d}", ".tok")
        n_docs, n_ids = write_shard(uri, (p for ps in ([first], pieces) for p in ps), width)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [uri], "n_docs": [n_docs], "n_ids": [n_ids]})

    rows = docs.select(id_or_least(id_column).alias("key"), F.col(text_column).cast("string").alias("text"))
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key", "text")
    return written(ordered.mapInArrow(write, "shard long, path string, n_docs long, n_ids long"), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Documents of the shards: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    spark = manifest.sparkSession
    shards, before = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r.shard):  # one row per file
        shards.append((r.path, before))
        before += r.n_ids
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not shards:
        return spark.createDataFrame([], schema)

    def read(batches):
        for batch in batches:
            for uri, before in zip(*(c.to_pylist() for c in batch.columns)):
                shard = TokenShard(uri)
                cuts = np.concatenate([[0], shard.ends.all().astype(np.int64)])
                names, row = shard.doc_ids(), 0
                while row < shard.n_docs:
                    to = max(row + 1, int(np.searchsorted(cuts, cuts[row] + OUT_BYTES // 4, side="right")) - 1)
                    ids = shard.ids(int(cuts[row]), int(cuts[to])).astype("<u4")
                    offsets = ((cuts[row : to + 1] - cuts[row]) * 4).astype(np.int64)
                    blob = pa.Array.from_buffers(pa.large_binary(), to - row, [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[row:to], pa.int64()), pa.array(before + cuts[row:to]), pa.array(np.diff(cuts[row : to + 1])), blob.cast(pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )
                    row = to
                shard.close()

    tasks = spark.createDataFrame(shards, "path string, before long").repartition(len(shards))
    return tasks.mapInArrow(read, schema)
