"""Repeated word windows removed: half-length anchors that repeat are doubled to the full length.

Level one: every window of 2L words elects its least L-word hash as anchor, so
equal windows elect equal anchors at the same place.  An anchor and the run of
windows that elected it travel as one row.  An anchor seen in one place alone
ends there.  Where all places of an anchor agree on the words of the whole run,
every place but the first is settled.  Only the rest is extended to twice the
length, window by window, and settled at level two; nothing survives beyond the
removal length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import _WORDS, PLAIN_WORD, Words, id_or_least, mix, ship, spans_hash, text_chunks, written

WINDOW = 20
_ROW = "h long, ctx long, doc long, key long, pack long"
_FOUND = "kind int, doc long, key long, pack long"
# key: hash of the text (tells texts apart that share an id); pack: the start above 8 bits of windows - 1 and 8 of the anchor's offset.
_START, _RUN = 16, 8


def _runs(w: Words, window: int):
    """Anchor hash, hash of the run's words, first window, windows, anchor offset of every run of a chunk."""
    from faultline.llm.shared import sliding_least

    level = window // 2
    half = w.window(level)
    starts = np.flatnonzero(w.left >= window)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    anchor = sliding_least(half, window - level + 1)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] != starts[:-1] + 1) | (anchor[1:] != anchor[:-1])
    at = np.flatnonzero(new)
    first, count = starts[at], np.diff(np.append(at, len(starts)))
    offset = anchor[at] - first
    words = spans_hash(w.hash, first, first + count - 1 + window, _WORDS)
    words = mix(words ^ (offset * 256 + count).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return half[anchor[at]], words, first, count, offset


def _rows(h: np.ndarray, ctx: np.ndarray, doc: np.ndarray, key: np.ndarray, pack: np.ndarray) -> pa.RecordBatch:
    """Rows of one batch with copies settled: of equal (h, ctx) the first is sent on, the rest is known to repeat."""
    order = np.lexsort((pack, key, doc, ctx, h))
    h, ctx, doc, key, pack = h[order], ctx[order], doc[order], key[order], pack[order]
    lead = np.ones(len(h), bool)
    lead[1:] = (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])
    first = np.maximum.accumulate(np.where(lead, np.arange(len(h)), 0)) if len(h) else np.zeros(0, np.int64)
    same = (doc == doc[first]) & (key == key[first]) & (pack == pack[first])  # a repeated row of one document: no place of its own
    keep = lead | ~same
    settled = ~lead
    h = np.where(settled, mix(doc.view(np.uint64) + np.uint64(1)), h)
    pack = np.where(settled, -1 - pack, pack)
    return pa.RecordBatch.from_arrays([pa.array(x[keep].view(np.int64)) for x in (h, ctx, doc, key, pack)], names=["h", "ctx", "doc", "key", "pack"])


def _first_pass(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy()
            keys = batch.column(1).to_numpy()
            parts = []
            for row, n, data, offsets in text_chunks(batch.column(2)):
                w = Words(data, offsets, PLAIN_WORD)
                h, ctx, first, count, offset = _runs(w, window)
                d = w.doc[first]
                pack = ((first - w.bounds[d]) << _START) | ((count - 1) << _RUN) | offset
                parts.append((h, ctx, docs[row + d], keys[row + d], pack))
            if parts:
                yield _rows(*(np.concatenate(c) for c in zip(*parts)))

    return run


def _second_pass(window: int):
    """Windows of the anchors still open, each with its full hash."""

    def run(batches):
        for batch in batches:
            docs, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            open_ = batch.column(3)
            cuts = open_.offsets.to_numpy()
            packs = open_.values.to_numpy()
            parts = []
            for row, n, data, offsets in text_chunks(batch.column(2)):
                w = Words(data, offsets, PLAIN_WORD)
                half = w.window(window // 2)
                p = packs[cuts[row] : cuts[row + n]]
                d = np.repeat(np.arange(n), np.diff(cuts[row : row + n + 1]))
                count = ((p >> _RUN) & 255) + 1
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                p, d = np.repeat(p, count), np.repeat(d, count)
                local = (p >> _START) + step
                offset = (p & 255) - step
                start = w.bounds[d] + local
                pack = (local << _START) | (offset & 255)
                parts.append((spans_hash(w.hash, start, start + window, _WORDS), half[start + offset], docs[row + d], keys[row + d], pack))
            if parts:
                yield _rows(*(np.concatenate(c) for c in zip(*parts)))

    return run


def _settle(mixed: bool):
    """Stream over rows sorted by (h, ctx, doc, pack): kind 0 repeats an earlier place, kind 1 has to be extended."""

    def out(kind, doc, key, pack):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int32)), pa.array(doc), pa.array(key), pa.array(pack)], names=["kind", "doc", "key", "pack"])

    def run(batches):
        last = None  # (h, ctx, doc, key, pack) of the first place of the last (h, ctx)
        several = False  # whether the last h has had more than one ctx
        for batch in batches:
            h, ctx, doc, key, pack = (c.to_numpy() for c in batch.columns)
            done = pack < 0
            if done.any():
                yield out(0, doc[done], key[done], -1 - pack[done])
                h, ctx, doc, key, pack = h[~done], ctx[~done], doc[~done], key[~done], pack[~done]
            n = len(h)
            if not n:
                continue
            carried = last is not None
            if carried:
                h, ctx, doc, key, pack = (np.concatenate([[a], b]) for a, b in zip(last, (h, ctx, doc, key, pack)))
            lead_h = np.ones(len(h), bool)
            lead_h[1:] = h[1:] != h[:-1]
            lead = lead_h.copy()
            lead[1:] |= ctx[1:] != ctx[:-1]
            first = np.maximum.accumulate(np.where(lead, np.arange(len(h)), 0))
            again = ~lead & ((doc != doc[first]) | (key != key[first]) | (pack != pack[first]))
            if again.any():
                yield out(0, doc[again], key[again], pack[again])
            if mixed:
                group = np.cumsum(lead_h) - 1
                kinds = np.bincount(group, weights=lead)
                many = kinds > 1
                if carried and several:
                    many[0] = True
                send = lead & many[group]
                if carried and several:
                    send[0] = False  # sent with its own batch
                if send.any():
                    yield out(1, doc[send], key[send], pack[send])
                several = bool(many[-1])
            k = first[-1]
            last = (h[k], ctx[k], doc[k], key[k], pack[k])

    return run


def _settled(rows: DataFrame, mixed: bool) -> DataFrame:
    ordered = rows.repartition("h").sortWithinPartitions("h", "ctx", "doc", "key", "pack")
    return ordered.mapInArrow(_settle(mixed), _FOUND)


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, key, pack) of every run of windows whose words start earlier too; ``docs`` has doc, key, text."""
    found = written(_settled(docs.select("doc", "key", "text").mapInArrow(_first_pass(window), _ROW), True), "anchors")
    again = found.where("kind = 0")
    still = found.where("kind = 1").groupBy("doc", "key").agg(F.collect_list("pack").alias("open"))
    widened = docs.join(still, ["doc", "key"]).select("doc", "key", "text", "open").mapInArrow(_second_pass(window), _ROW)
    deeper = written(_settled(widened, False), "windows")
    return again.unionByName(deeper).select("doc", "key", "pack")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: words covered by a repeated window are removed.

    A window of ``window`` (even, 4 to 400) words repeats if the same words start
    earlier: in a smaller doc_id, or earlier in the document.  The first place
    stays.  Null text has no words; a null doc_id counts as the smallest; rows
    that repeat a doc_id with the same text are one place and get the same
    result; with different texts they are ordered by a hash of the text.  Texts
    shorter than a window stay whole.  Other columns are not read.
    """
    if window % 2 or not 4 <= window <= 400:
        raise ValueError("window must be even, 4 to 400")
    ship(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id"), id_or_least().alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("key", F.xxhash64("text"))
    runs = repeated_windows(rows, window).groupBy("doc", "key").agg(F.collect_list("pack").alias("runs"))

    def cut(batches):
        for batch in batches:
            lists = batch.column(2)
            valid = lists.is_valid().to_numpy(zero_copy_only=False)
            n_words, n_removed, kept = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = text.encode().split()
                n_words.append(len(words))
                if not valid[i]:
                    n_removed.append(0)
                    kept.append(b" ".join(words))
                    continue
                p = lists[i].values.to_numpy()
                start = p >> _START
                edge = np.bincount(start, minlength=len(words) + 1) - np.bincount(start + ((p >> _RUN) & 255) + window, minlength=len(words) + 1)
                stay = np.cumsum(edge)[:-1] == 0
                n_removed.append(len(words) - int(stay.sum()))
                kept.append(b" ".join(compress(words, stay)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )

    joined = rows.join(runs, ["doc", "key"], "left").select("doc_id", "text", "runs")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {id_type}, n_words long, n_removed long, kept_text string")
