"""Benchmark decontamination by winnowing: least k-gram of each window, looked up and extended to the whole window."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import ALNUM_WORD, FOLD_ASCII, _WORDS, Words, memory_returned, mix, ship, sliding_least, spans_hash, text_chunks, written

WINDOW, GRAM = 13, 5
BLOCK_WINDOWS = 2_000_000  # largest benchmark, in windows, that travels to the tasks: some 50 MB
SPANS = "array<struct<start:int,end:int>>"
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
SALTS = 16  # places of one fingerprint: copies of a text are one key, but many texts may share a passage


def _winnowed(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of every full window and the place and hash of its least k-gram."""
    starts = np.flatnonzero(w.left >= WINDOW)
    grams = w.window(GRAM)
    place = sliding_least(grams, WINDOW - GRAM + 1)[starts] if len(starts) else starts
    return starts, place, grams[place] if len(starts) else np.zeros(0, np.uint64)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """size, whole, gram, item_id of every window; an item of fewer words than a window is one window of its own size."""

    def run(batches):
        for batch in batches:
            items = batch.column(0)
            for row, n, data, offsets in text_chunks(batch.column(1)):
                w = Words(data, offsets, ALNUM_WORD, FOLD_ASCII)
                starts, _, gram = _winnowed(w)
                short = np.flatnonzero((w.counts > 0) & (w.counts < WINDOW))
                first = np.concatenate([starts, w.bounds[short]])
                size = np.concatenate([np.full(len(starts), WINDOW), w.counts[short]])
                whole = spans_hash(w.hash, first, first + size, _WORDS)
                gram = np.concatenate([gram, np.zeros(len(short), np.uint64)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(size.astype(np.int32)), pa.array(whole.view(np.int64)), pa.array(gram.view(np.int64)), items.take(pa.array(row + w.doc[first]))],
                    names=["size", "whole", "gram", "item_id"],
                )

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "size int, whole long, gram long, item_id long").distinct()


class _Block:
    """One block of benchmark windows: sorted hashes by size, the items of each, fingerprints of the full ones."""

    def __init__(self, table: pa.Table):
        size = table.column("size").to_numpy()
        whole = table.column("whole").to_numpy().view(np.uint64)
        item = table.column("item_id")
        known = item.is_valid().to_numpy()
        item = item.fill_null(0).to_numpy()
        self.grams = np.unique(table.column("gram").to_numpy().view(np.uint64)[size == WINDOW])
        self.sizes = {}
        for s in np.unique(size):
            mine = size == s
            order = np.argsort(whole[mine], kind="stable")
            codes, first = np.unique(whole[mine][order], return_index=True)
            self.sizes[int(s)] = (codes, np.append(first, mine.sum()), item[mine][order], known[mine][order])


def _member(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values that a sorted table holds, and their places in it."""
    if not len(table):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    found = np.flatnonzero(table[at] == values)
    return found, at[found]


def _hits(w: Words, block: _Block):
    """First word, size and place in the block's table of every window that occurs."""
    out = []
    for size, (codes, _, _, _) in block.sizes.items():
        if size == WINDOW:
            starts, _, gram = _winnowed(w)
            near, _ = _member(gram, block.grams)  # fingerprints met; now the whole window
            starts = starts[near]
        else:
            starts = np.flatnonzero(w.left >= size)
        found, at = _member(spans_hash(w.hash, starts, starts + size, _WORDS), codes)
        out.append((starts[found], np.full(len(found), size), at))
    return out


def _merged(spans) -> list[dict[str, int]]:
    """Ranges of words with overlapping and touching ones joined."""
    joined: list[list[int]] = []
    for start, end in sorted(spans):
        if joined and start <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([start, end])
    return [{"start": a, "end": e} for a, e in joined]


def _mark(block, carry: int, text_at: int):
    def run(batches):
        b = block.value
        for batch in batches:
            n_rows = batch.num_rows
            spans: list[list] = [[] for _ in range(n_rows)]
            items: list[set] = [set() for _ in range(n_rows)]
            n_words = np.zeros(n_rows, np.int64)
            for row, n, data, offsets in text_chunks(batch.column(text_at)):
                w = Words(data, offsets, ALNUM_WORD, FOLD_ASCII)
                n_words[row : row + n] = w.counts
                for (start, size, at), (_, cuts, names, known) in zip(_hits(w, b), b.sizes.values()):
                    if not len(start):
                        continue
                    d = w.doc[start]
                    edges = np.append(np.flatnonzero(np.append(True, d[1:] != d[:-1])), len(d))
                    for lo, hi in zip(edges[:-1], edges[1:]):
                        k = row + int(d[lo])
                        local = start[lo:hi] - w.bounds[d[lo]]
                        spans[k] += list(zip(local.tolist(), (local + size[lo:hi]).tolist()))
                        for c in np.unique(at[lo:hi]):
                            mine = slice(cuts[c], cuts[c + 1])
                            items[k].update(names[mine][known[mine]].tolist())
            merged = [_merged(s) for s in spans]
            new = [pa.array(merged, SPAN_TYPE), pa.array([sorted(i) for i in items], pa.list_(pa.int64())), pa.array(n_words)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:carry], *new], names=[*batch.schema.names[:carry], "_hit_spans", "_hit_items", "_n_words"])
            memory_returned()

    return run


def _fingerprints(short: list[int]):
    """(k, k2, size, code) of every text: its winnowed grams, and its windows of the sizes of short items."""

    def run(batches):
        for batch in batches:
            for row, _, data, offsets in text_chunks(batch.column(2)):
                w = Words(data, offsets, ALNUM_WORD, FOLD_ASCII)
                starts, _, gram = _winnowed(w)
                found = [(WINDOW, w.doc[starts], gram)]
                for size in short:
                    starts = np.flatnonzero(w.left >= size)
                    found.append((size, w.doc[starts], spans_hash(w.hash, starts, starts + size, _WORDS)))
                for size, doc, code in found:
                    order = np.lexsort((code, doc))
                    doc, code = doc[order], code[order]
                    new = np.ones(len(doc), bool)
                    new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
                    at = pa.array(row + doc[new])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.full(new.sum(), size, np.int32)), pa.array(code[new].view(np.int64))],
                        names=["k", "k2", "size", "code"],
                    )

    return run


def _met_windows(batches):
    """(k, k2, start, size, whole) of the windows whose fingerprints the benchmark has too."""
    for batch in batches:
        lists = batch.column(3)
        cuts, open_ = lists.offsets.to_numpy(), lists.values
        sizes, codes = open_.field("size").to_numpy(), open_.field("code").to_numpy().view(np.uint64)
        for row, n, data, offsets in text_chunks(batch.column(2)):
            w = Words(data, offsets, ALNUM_WORD, FOLD_ASCII)
            mine = slice(cuts[row], cuts[row + n])
            of = np.repeat(np.arange(n, dtype=np.uint64), np.diff(cuts[row : row + n + 1]))
            for size in np.unique(sizes[mine]):
                if size == WINDOW:
                    starts, _, code = _winnowed(w)
                else:
                    starts = np.flatnonzero(w.left >= size)
                    code = spans_hash(w.hash, starts, starts + size, _WORDS)
                here = sizes[mine] == size
                wanted = mix(codes[mine][here] ^ mix(of[here] + np.uint64(1)))
                near = np.isin(mix(code ^ mix(w.doc[starts].astype(np.uint64) + np.uint64(1))), wanted)
                starts = starts[near]
                doc = w.doc[starts]
                at = pa.array(row + doc)
                whole = spans_hash(w.hash, starts, starts + size, _WORDS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array((starts - w.bounds[doc]).astype(np.int32)),
                     pa.array(np.full(len(doc), size, np.int32)), pa.array(whole.view(np.int64))],
                    names=["k", "k2", "start", "size", "whole"],
                )


def _noted(carry: int, text_at: int):
    """Words counted, spans merged, items sorted; the last two columns are the spans and items found."""

    def run(batches):
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            for row, n, data, offsets in text_chunks(batch.column(text_at)):
                n_words[row : row + n] = Words(data, offsets, ALNUM_WORD, FOLD_ASCII).counts
            spans = [_merged((s["start"], s["end"]) for s in v or ()) for v in batch.column(carry).to_pylist()]
            items = [sorted(v or ()) for v in batch.column(carry + 1).to_pylist()]
            new = [pa.array(spans, SPAN_TYPE), pa.array(items, pa.list_(pa.int64())), pa.array(n_words)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:carry], *new], names=[*batch.schema.names[:carry], "_hit_spans", "_hit_items", "_n_words"])

    return run


def _found_by_join(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """(k, k2, spans, items) per text that has hits; a text is known by two hashes, so its copies are one.

    Fingerprints of texts and benchmark are joined first, then the whole windows
    of the few texts that share one.
    """
    keyed = rows.selectExpr("xxhash64(text) as k", "xxhash64(1, text) as k2", "text")
    short = [r["size"] for r in windows.where(F.col("size") < WINDOW).select("size").distinct().collect()]  # at most 12 rows
    codes = windows.selectExpr("size", f"case when size = {WINDOW} then gram else whole end as code").distinct()
    codes = codes.withColumn("salt", F.expr(f"explode(sequence(0, {SALTS - 1}))"))
    prints = keyed.mapInArrow(_fingerprints(short), "k long, k2 long, size int, code long")
    prints = prints.withColumn("salt", F.expr(f"cast(pmod(k, {SALTS}) as int)"))
    met = prints.join(codes, ["size", "code", "salt"], "left_semi").groupBy("k", "k2").agg(F.collect_set(F.struct("size", "code")).alias("open"))
    asked = keyed.join(written(met, "fingerprints"), ["k", "k2"]).select("k", "k2", "text", "open")
    found = written(asked.mapInArrow(_met_windows, "k long, k2 long, start int, size int, whole long").distinct(), "windows")
    hits = found.join(windows.select("size", "whole", "item_id"), ["size", "whole"])
    return hits.groupBy("k", "k2").agg(
        F.expr("collect_set(struct(start, start + size as end))").alias("spans"), F.collect_set("item_id").alias("items"))


def mark(docs: DataFrame, benchmark: DataFrame, *, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of ``docs`` with ``_hit_spans`` (merged word ranges), ``_hit_items`` and ``_n_words``.

    Every document word inside an occurrence of a benchmark window is hit.  The
    benchmark's windows are counted first: up to ``block_windows`` they travel to
    the tasks and no document is shuffled; beyond, fingerprints and windows are
    joined by shuffles and nothing reaches the driver.  Both give the same rows.
    Null text has no words; an item without words has no window; an item with a
    null id hits but is not listed.  Columns of these names, and ``_hit_key``
    and ``_hit_key2``, are replaced in ``docs``.  Rows are never merged, so
    repeated ids, ties and null ids need no rule.  An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.drop("_hit_spans", "_hit_items", "_n_words", "_hit_key", "_hit_key2")
    windows = benchmark_windows(benchmark)
    carry, text_at = len(rows.columns), rows.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    schema = f"{schema}, _hit_spans {SPANS}, _hit_items array<bigint>, _n_words long"
    if windows.count() <= block_windows:
        shared = spark.sparkContext.broadcast(_Block(windows.toArrow()))  # at most block_windows rows
        return rows.mapInArrow(_mark(shared, carry, text_at), schema)
    found = _found_by_join(rows.select(F.col("text").cast("string").alias("text")), written(windows, "benchmark"))
    found = found.selectExpr("k as _hit_key", "k2 as _hit_key2", "spans as _hit_spans", "items as _hit_items")
    keyed = rows.withColumns({"_hit_key": F.expr("xxhash64(cast(text as string))"), "_hit_key2": F.expr("xxhash64(1, cast(text as string))")})
    joined = keyed.join(found, ["_hit_key", "_hit_key2"], "left").select(*[F.col(f"`{c}`") for c in rows.columns], "_hit_spans", "_hit_items")
    return joined.mapInArrow(_noted(carry, text_at), schema)


def n_hit() -> Column:
    return F.aggregate("_hit_spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))


def contaminated() -> Column:
    """At least one word in twenty, and at least one, lies in a benchmark window."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("_n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that are not contaminated, with the columns they came with."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    plain = docs.select(*[c.alias(f"_c{i}") if n != "text" else c.alias("text") for i, (n, c) in enumerate(zip(docs.columns, names))])
    kept = mark(plain, benchmark).where(~contaminated())
    return kept.select(*[F.col("text" if n == "text" else f"_c{i}").alias(n) for i, n in enumerate(docs.columns)])
