"""Phrase collocations by relational set mining: sorted occurrence relations, merge-joined at adjacent positions.

Relation R(k) holds every occurrence of a k-word phrase whose parts are
frequent, sorted by piece and position.  It is kept per block of whole
documents: one row with the block's positions and phrase codes, beside a
dictionary of the block's distinct phrases and their counts, dealt into buckets
by a hash of the phrase: one row per block and bucket.  A level is

    group-count    a bucket's dictionary rows of all blocks are merged and summed
    semi-join      each goes back to its block as the list of its frequent phrases
    merge-join     R(k) with itself at adjacent positions of one piece: R(k+1)

so occurrences are never shuffled by phrase, and a phrase that holds a third of
them is one entry per block of ``BLOCK_BYTES``.  A (k+1)-word phrase is the pair of its
first and its last k words, by the numbers of those frequent phrases.  Codes follow
the order of the dictionary, so entries and answers travel without them, as
numbers of few bytes.  Words and phrases are compared in full, never by hash.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from faultline.llm.shared import _BYTE_CODE, _BYTES, FOLD_ASCII, dropped, mix, ship, shuffles_freed, spans_hash, text_chunks, written

MIN_COUNT, LONGEST, TOP, SHARE = 100, 5, 2000, 100
BLOCK_BYTES = 4 << 20
LEAST_BITS, BUCKET_BYTES = 8, 32 << 20  # 256 buckets or more, one per so many bytes of text
JOINT = 1 << 32  # numbers below it are paired in 64 bits
_ODD = 0x9E3779B97F4A7C15
UNKNOWN = "und"
HOT_SHARE = 1000
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_INSIDE = ~_BREAK
_INSIDE[[0x20, 0x09]] = False
_ROWS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("step", pa.binary()), ("code", pa.binary()), ("keys", pa.binary()), ("more", pa.binary()), ("n", pa.binary())])
_OCCURRENCES = "block long, bucket int, step binary, code binary, keys binary, more binary, n binary"
_PHRASE = pa.struct([("place", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("left", pa.int64()), ("right", pa.int64()), ("a", pa.int64())])
_ANSWERS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("answer", pa.binary()), ("used", pa.int64()), ("list", pa.list_(_PHRASE))])
_COUNTED = "block long, bucket int, answer binary, used long, list array<struct<place:long,lang:string,word:string,left:long,right:long,a:long>>"


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of a chunk, the document of each, and its position: one more than the last, two more where a piece ends between."""
    data = FOLD_ASCII[data]
    inside = _INSIDE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a document starts or ends
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    breaks = np.cumsum(_BREAK[data])
    piece = breaks[start] + doc  # both only grow
    position = np.arange(len(start)) + np.concatenate([[0], np.cumsum(piece[1:] != piece[:-1])]) if len(start) else start
    cuts = np.concatenate([[0], np.cumsum(end - start)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data[inside])])
    return words.cast(pa.large_string()), doc, position


def _squeezed(raw: bytes) -> tuple[bool, bytes]:
    """Compressed, where that is shorter."""
    small = pa.compress(raw, codec="zstd", asbytes=True)
    return (True, small) if len(small) < len(raw) else (False, raw)


def _packed(values: np.ndarray) -> bytes:
    """Numbers from 0 on, in as many bytes each as the largest needs, all first bytes first."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    squeezed, data = _squeezed(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    return struct.pack("<BBI", width, squeezed, len(values)) + data


def _unpacked(data: bytes) -> np.ndarray:
    width, squeezed, n = struct.unpack_from("<BBI", data)
    raw = data[6:] if not squeezed else pa.decompress(data[6:], decompressed_size=width * n, codec="zstd", asbytes=True)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(n)


def _packed_words(words: pa.LargeStringArray) -> tuple[bytes, bytes]:
    """Their bytes end to end, and their lengths."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = words.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else b""
    squeezed, data = _squeezed(raw)
    return struct.pack("<BQ", squeezed, len(raw)) + data, _packed(np.diff(offsets))


def _unpacked_words(data: bytes, lengths: bytes) -> tuple[bytes, np.ndarray]:
    squeezed, size = struct.unpack_from("<BQ", data)
    return data[9:] if not squeezed else pa.decompress(data[9:], decompressed_size=size, codec="zstd", asbytes=True), _unpacked(lengths).astype(np.int64)


def _rows(block: int, position: np.ndarray, code: np.ndarray, dictionary: list[tuple[int, bytes, bytes | None, bytes]]) -> pa.RecordBatch:
    """A block's row of the relation, without a bucket, and a row per bucket of its dictionary."""
    empty = [None] * len(dictionary)
    bucket, keys, more, n = (list(c) for c in zip(*dictionary))
    columns = [
        [block] * (1 + len(dictionary)), [None, *bucket], [_packed(np.diff(position, prepend=0)), *empty], [_packed(code), *empty],
        [None, *keys], [None, *more], [None, *n],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROWS)], schema=_ROWS)


def _runs(sorted_: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of each run of equal numbers."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(sorted_)) + 1, [len(sorted_)]]).tolist()
    for start, end in zip(cuts[:-1], cuts[1:]):
        yield int(sorted_[start]), start, end


def _ranks(order: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def _first_relation(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """R(1) and its dictionary; a word and its language are one string, parted by a space, which no word has."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32  # blocks are numbered by the task that cuts them
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        names = langs.dictionary.cast(pa.large_string())
        lang_of = np.asarray(langs.indices)
        for row, n, data, offsets in text_chunks(batch.column(1), BLOCK_BYTES):
            words, doc, position = _words(data, offsets)
            if not len(words):
                continue
            coded = words.dictionary_encode()
            joint = lang_of[row + doc].astype(np.int64) * len(coded.dictionary) + np.asarray(coded.indices)
            distinct, code, count = np.unique(joint, return_inverse=True, return_counts=True)
            lang, word = np.divmod(distinct, len(coded.dictionary))
            spelled = coded.dictionary
            cuts = np.frombuffer(spelled.buffers()[1], np.int64)[spelled.offset : spelled.offset + len(spelled) + 1]
            hashed = spans_hash(_BYTE_CODE[np.frombuffer(spelled.buffers()[2], np.uint8)], cuts[:-1], cuts[1:], _BYTES)
            bucket = (hashed >> np.uint64(64 - bits)).astype(np.int64)[word]
            order = np.argsort(bucket, kind="stable")
            keys = pc.binary_join_element_wise(spelled.take(pa.array(word[order])), names.take(pa.array(lang[order])), pa.scalar(" ", pa.large_string()))
            yield _rows(block, position, _ranks(order)[code], [(b, *_packed_words(keys.slice(s, e - s)), _packed(count[order][s:e])) for b, s, e in _runs(bucket[order])])
            block += 1


def _width(bound: int, bits: int) -> int:
    """Bits of a pair of numbers below ``bound``, no fewer than those of a bucket."""
    return max(bits, (bound * bound - 1).bit_length())


def _dealt(left: np.ndarray, right: np.ndarray, count: np.ndarray, bound: int, bits: int) -> tuple[np.ndarray, list[tuple[int, bytes, bytes | None, bytes]]]:
    """The order of a block's dictionary, and its rows by bucket.

    Pairs are spread over all numbers of their width by an odd factor, which a
    bucket's task takes back; sorted, their steps need few bytes.  Beyond ``JOINT``
    both numbers travel.
    """
    if bound > JOINT:
        bucket = (mix(left.astype(np.uint64) * np.uint64(_ODD) + right.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        left, right, count = left[order], right[order], count[order]
        return order, [(b, _packed(left[s:e]), _packed(right[s:e]), _packed(count[s:e])) for b, s, e in _runs(bucket[order])]
    width = _width(bound, bits)
    spread = (left.astype(np.uint64) * np.uint64(bound) + right.astype(np.uint64)) * np.uint64(_ODD) & np.uint64((1 << width) - 1)
    order = np.argsort(spread)
    spread, count = spread[order], count[order]
    bucket = (spread >> np.uint64(width - bits)).astype(np.int64)
    return order, [(b, _packed(np.diff(spread[s:e], prepend=np.uint64(b << (width - bits)))), None, _packed(count[s:e])) for b, s, e in _runs(bucket)]


def _answered(table: pa.Table, place: np.ndarray, total: np.ndarray, sizes: list[int], min_count: int, phrases) -> pa.Table:
    """For each dictionary row of a bucket, the frequent phrase at each place, from 1, or 0; and a row with those phrases."""
    often = total >= min_count
    number = np.where(often, np.cumsum(often), 0)[place]
    cuts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    answers = [_packed(number[s:e]) for s, e in zip(cuts[:-1], cuts[1:])]
    block, bucket = table.column("block").to_pylist(), table.column("bucket")[0].as_py()
    columns = [[*block, None], [bucket] * (len(block) + 1), [*answers, None], [None] * len(block) + [int(often.sum())]]
    listed = pa.concat_arrays([pa.nulls(len(block), pa.list_(_PHRASE)), pa.ListArray.from_arrays(pa.array([0, len(found := phrases(often))], pa.int32()), found)])
    return pa.Table.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, _ANSWERS)), listed], schema=_ANSWERS)


def _phrase_rows(n: int, **given) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in _PHRASE], fields=list(_PHRASE))


def _counts(table: pa.Table, place: np.ndarray) -> np.ndarray:
    n = np.concatenate([_unpacked(x.as_py()) for x in table.column("n")]).astype(np.int64)
    out = np.zeros(int(place.max()) + 1, np.int64)
    np.add.at(out, place, n)
    return out


def _counted_words(table: pa.Table, min_count: int) -> pa.Table:
    """Answers and frequent words of one bucket; rows without a word count all words of a language."""
    parts = [_unpacked_words(k.as_py(), m.as_py()) for k, m in zip(table.column("keys"), table.column("more"))]
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([lengths for _, lengths in parts]))]).astype(np.int64)
    keys = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(b"".join(raw for raw, _ in parts))).dictionary_encode()
    place = np.asarray(keys.indices)
    total = _counts(table, place)

    def phrases(often: np.ndarray) -> pa.StructArray:
        texts = [t.partition(" ") for t in keys.dictionary.to_pylist()]
        langs = [lang for _, _, lang in texts]
        whole: dict[str, int] = {}
        for lang, n in zip(langs, total.tolist()):
            whole[lang] = whole.get(lang, 0) + n
        at = np.flatnonzero(often).tolist()
        return pa.concat_arrays([
            _phrase_rows(len(at), place=np.arange(len(at)), lang=[langs[i] for i in at], word=[texts[i][0] for i in at], a=total[at]),
            _phrase_rows(len(whole), lang=list(whole), a=list(whole.values())),
        ])

    return _answered(table, place, total, [len(lengths) for _, lengths in parts], min_count, phrases)


def _counted_pairs(table: pa.Table, bound: int, bits: int, min_count: int) -> pa.Table:
    """Answers and frequent pairs of one bucket."""
    parts = [_unpacked(k.as_py()) for k in table.column("keys")]
    sizes = [len(x) for x in parts]
    if bound > JOINT:
        left, right = np.concatenate(parts).astype(np.int64), np.concatenate([_unpacked(m.as_py()) for m in table.column("more")]).astype(np.int64)
        (left, right), place = np.unique(np.stack([left, right]), axis=1, return_inverse=True)
    else:
        width = _width(bound, bits)
        base = np.uint64(table.column("bucket")[0].as_py() << (width - bits))
        spread, place = np.unique(np.concatenate([base + np.cumsum(x, dtype=np.uint64) for x in parts]), return_inverse=True)
        left, right = np.divmod(spread * np.uint64(pow(_ODD, -1, 1 << 64)) & np.uint64((1 << width) - 1), np.uint64(bound))
    place = place.reshape(-1)
    total = _counts(table, place)
    return _answered(table, place, total, sizes, min_count, lambda often: _phrase_rows(int(often.sum()), place=np.arange(often.sum()), left=left[often].astype(np.int64), right=right[often].astype(np.int64), a=total[often]))


def _extended(left: pa.Table, right: pa.Table, starts: np.ndarray, bits: int) -> pa.Table:
    """R(k+1) of one block: R(k), semi-joined by the answers, merge-joined with itself at adjacent positions."""
    position = np.cumsum(_unpacked(left.column("step")[0].as_py()).astype(np.int64))
    code = _unpacked(left.column("code")[0].as_py()).astype(np.int64)
    answers = sorted(zip(right.column("bucket").to_pylist(), right.column("answer").to_pylist()))  # codes follow the buckets
    gid = np.concatenate([np.where(x > 0, starts[b] + x - 1, -1) for b, x in ((b, _unpacked(a).astype(np.int64)) for b, a in answers)])
    number = np.full(len(gid), -1, np.int64)
    order = np.argsort(gid)[int((gid < 0).sum()) :]
    number[order] = np.arange(len(order))
    gid, place = gid[order], number[code]
    known = place >= 0
    position, place = position[known], place[known]
    meets = np.flatnonzero(np.diff(position) == 1)
    if not len(meets):
        return _ROWS.empty_table()
    distinct, new, count = np.unique(place[meets] * len(gid) + place[meets + 1], return_inverse=True, return_counts=True)
    first, last = np.divmod(distinct, len(gid))
    order, dictionary = _dealt(gid[first], gid[last], count, int(starts[-1]), bits)
    return pa.Table.from_batches([_rows(left.column("block")[0].as_py(), position[meets], _ranks(order)[new], dictionary)])


def split_join(many: DataFrame, few: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join with ``few``, unique by ``keys`` with ``rows``, the rows each has in ``many`` of ``total``.

    At most ``HOT_SHARE`` keys can hold more than that part of ``many``: those
    are sent to all tasks, and no task gets more than that of any other key.
    """
    hot = F.col("rows") > max(HOT_SHARE, total // HOT_SHARE)
    top = F.broadcast(few.where(hot).drop("rows"))
    rest = few.where(~hot).drop("rows")
    return many.join(top, keys).unionByName(many.join(F.broadcast(few.where(hot).select(*keys)), keys, "left_anti").join(rest, keys))


def _frequent(entries: DataFrame, keys: list[str], min_count: int) -> tuple[DataFrame, int]:
    """block, local, keys, a and gid of the dictionary rows of frequent phrases, and a bound of the gids.

    gids are fixed by being written, then moved together, task after task: a bound
    below 2^31.5 lets two of them share a number.  Count and place of a row travel
    as one number, too.
    """
    over = W.partitionBy(*keys)
    rows = entries.select("block", *keys, F.expr("shiftleft(n, 32) | local").alias("held")).repartition(*keys)  # unpacked after it
    rows = rows.select("block", *keys, F.expr("cast(held & 2147483647 as int)").alias("local"), F.expr("shiftright(held, 32)").alias("n"))
    counted = rows.withColumn("a", F.sum("n").over(over)).where(F.col("a") >= min_count).withColumn("row", F.monotonically_increasing_id())
    found = written(counted.withColumn("gid", F.min("row").over(over)).select("block", "local", *keys, "a", "gid"), "frequent")
    task = F.expr("cast(shiftright(gid, 33) as int)")
    within = F.expr(f"gid & {(1 << 33) - 1}L")
    used = {r.task: r.n for r in found.groupBy(task.alias("task")).agg((F.max(within) + 1).alias("n")).collect()}  # a row per task
    starts = np.concatenate([[0], np.cumsum([used.get(k, 0) for k in range(max(used, default=0) + 1)])]).tolist()
    first = F.element_at(F.expr("array(" + ", ".join(f"{int(x)}L" for x in starts[:-1]) + ")"), task + 1)
    return found.withColumn("gid", first + within), max(1, int(starts[-1]))


def _paired(entries: DataFrame, bound: int) -> tuple[DataFrame, list[str]]:
    """Rows whose left and right are one number where it has room for both, and the columns to group by."""
    if bound * bound >= 1 << 63:
        return entries, ["left", "right"]
    return entries.withColumn("pair", F.expr(f"left * {bound}L + right")).drop("left", "right"), ["pair"]


def _parted(found: DataFrame, bound: int) -> DataFrame:
    """left and right again."""
    if "pair" not in found.columns:
        return found
    return found.withColumns({"left": F.expr(f"pair div {bound}L"), "right": F.expr(f"pair % {bound}L")}).drop("pair")


def _counted(relation: DataFrame, count) -> tuple[DataFrame, np.ndarray]:
    """Answers and frequent phrases by bucket, and the first number of each bucket's phrases; the last is how many there are."""
    counted = written(relation.where(F.col("bucket").isNotNull()).select("block", "bucket", "keys", "more", "n").groupBy("bucket").applyInArrow(count, _COUNTED), "frequent")
    used = dict(counted.where(F.col("used").isNotNull()).select("bucket", "used").collect())  # a row per bucket
    return counted, np.concatenate([[0], np.cumsum([used.get(b, 0) for b in range(max(used, default=0) + 1)])])


def _gid(starts: np.ndarray) -> Column:
    return F.element_at(F.expr("array(" + ", ".join(f"{x}L" for x in starts[:-1].tolist()) + ")"), F.col("bucket") + 1) + F.col("place")


def _merge_joined(relation: DataFrame, counted: DataFrame, starts: np.ndarray, bits: int) -> DataFrame:
    """R(k+1) and its dictionary, block by block."""
    blocks = relation.where(F.col("bucket").isNull()).select("block", "step", "code").groupBy("block")
    answers = counted.where(F.col("block").isNotNull()).select(F.col("block").alias("of"), "bucket", "answer").groupBy("of")
    return blocks.cogroup(answers).applyInArrow(lambda left, right: _extended(left, right, starts, bits), _OCCURRENCES)


def _with_parts(frequent: DataFrame, below: DataFrame) -> DataFrame:
    """Phrase text and the counts of all first and last parts, from those of the first and the last k words."""
    total = frequent.count()
    for side in ("left", "right"):
        uses = frequent.groupBy(side).agg(F.count(F.lit(1)).alias("rows")).withColumnRenamed(side, "gid")
        part = below.join(uses, "gid").select(F.col("gid").alias(side), "rows", *([F.col("lang"), F.col("words").alias("head"), "heads"] if side == "left" else [F.col("words").alias("tail"), "tails"]))
        frequent = split_join(frequent, part, [side], total)
    return frequent.select(
        "gid", "left", "right", "lang", "a", F.concat("head", F.array(F.element_at("tail", -1))).alias("words"),
        F.concat("heads", F.array("a")).alias("heads"), F.concat("tails", F.array("a")).alias("tails"),
    )


def frequent_phrases(docs: DataFrame, *, min_count: int = MIN_COUNT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Phrases of one to ``longest`` words seen ``min_count`` times or more in their language, and the words of each language.

    gid, left and right (the phrase without its last and first word), lang,
    words, a, and heads and tails: the counts of its first and last 1, 2, ... words.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LEAST_BITS, (size // BUCKET_BYTES).bit_length())
    relation = written(rows.mapInArrow(lambda batches: _first_relation(batches, bits), _OCCURRENCES), "occurrences")
    counted, starts = _counted(relation, lambda table: _counted_words(table, min_count))
    listed = counted.select("bucket", F.inline("list"))
    totals = written(listed.where(F.col("word").isNull()).groupBy("lang").agg(F.sum("a").alias("n")), "totals")
    level = listed.where(F.col("word").isNotNull()).select(
        _gid(starts).alias("gid"), F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"), "lang", "a",
        F.array("word").alias("words"), F.array("a").alias("heads"), F.array("a").alias("tails"),
    )
    level = written(level, "phrases")
    every = [level]
    for k in range(1, longest):
        wider = written(_merge_joined(relation, counted, starts, bits), "occurrences")
        dropped(relation)
        dropped(counted)
        bound, relation = int(starts[-1]), wider
        counted, starts = _counted(relation, lambda table: _counted_pairs(table, bound, bits, min_count))
        pairs = counted.select("bucket", F.inline("list")).select(_gid(starts).alias("gid"), "left", "right", "a")
        level = written(_with_parts(pairs, level), "phrases")
        every.append(level)
        if level.isEmpty():
            break
    dropped(relation)
    dropped(counted)
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return out, totals


def cut_score() -> str:
    """(score, at) of the lowest cut of ``k`` words, from a, n, heads and tails; products are exact to 38 digits."""
    big = "cast({} as decimal(19, 0))".format
    return (
        f"array_min(transform(sequence(1, k - 1), i -> struct(cast(({big('a')} * {big('n')} * 1000) div "
        f"({big('heads[i - 1]')} * {big('tails[k - i - 1]')}) as bigint) as score, i as at)))"
    )


def collocations(docs: DataFrame, *, top: int = TOP, **how: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of two words or more.

    A phrase is cut where floor(1000 a n / (l r)) is lowest, ties at the shortest
    first part; it is dropped if a longer one that holds it is as frequent, which
    one word more decides: counts only fall as phrases grow.  Null text is empty,
    null lang is ``und``; texts without words add nothing; repeated rows count
    again; an empty table gives no rows; other columns are not read.
    """
    with shuffles_freed(docs.sparkSession):
        every, totals = frequent_phrases(docs, **how)
        phrases = every.where(F.size("words") > 1)
        wider = phrases.where(F.size("words") > 2)
        covers = wider.select(F.col("left").alias("gid"), "a", F.size("words").alias("k")).unionByName(wider.select(F.col("right").alias("gid"), "a", F.size("words").alias("k")))
        covers = covers.groupBy("gid", (F.col("k") - 1).alias("k")).agg(F.max("a").alias("widest"))
        best = phrases.withColumn("k", F.size("words")).join(covers, ["gid", "k"], "left")
        best = best.where(F.col("widest").isNull() | (100 * F.col("widest") < SHARE * F.col("a")))
        best = best.join(totals, "lang")
        scored = best.withColumn("cut", F.expr(cut_score())).select(
            "lang", F.array_join("words", " ").alias("phrase"), "a", F.expr("heads[cut.at - 1]").alias("l"), F.expr("tails[k - cut.at - 1]").alias("r"), "n", F.expr("cut.score").alias("score")
        )
        order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
        spread = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(256)))
        some = spread.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
        ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        return written(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
