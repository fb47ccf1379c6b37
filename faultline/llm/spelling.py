"""Spelling variants by finite-state composition: vocabulary acceptor, one-edit transducer, vocabulary acceptor.

Two words one edit apart, the shorter of m code points, share all before the
first difference (at place e) and all after the edit.  An edit range [lo, hi)
of e therefore fixes an initial state (m, lo, hi, first lo code points, last
m - hi code points): every pair whose edit lies in the range has both words in
the partition of one such state.  Ranges start as the two halves of a word; a
partition of more than ``LIMIT`` words is replaced by those of the halves of
its range, down to one place, where the alphabet bounds its size.

Within a partition the words of m and of m + 1 code points become one minimal
acceptor (equal right languages are one state).  Its composition with the
one-edit transducer is walked along equal labels; an edit arc leads to a pair
of states whose common right language, kept per pair, gives the rest of the
accepted pairs.  The edit is made at the first difference only, so each pair is
accepted once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import ship, shuffles_freed, written

LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, RATIO, NOISE = 7, 2, 10, 31
LIMIT = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def occurrences(docs: DataFrame, *, noise: int = NOISE, min_length: int = MIN_LENGTH) -> DataFrame:
    """word of every run of at least ``min_length`` letters, one code point deleted where the contract's hash says so."""
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    rows = rows.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = "cast(h % length(run) as int)"
    word = f"case when h % {noise} = 0 then concat(substring(run, 1, {at}), substring(run, {at} + 2)) else run end"
    return rows.select(F.expr(word).alias("word")).where(F.length("word") >= min_length)


def vocabulary(docs: DataFrame, **how: int) -> DataFrame:
    """word, n of the words seen ``MIN_COUNT`` times or more; counted before the shuffle."""
    return occurrences(docs, **how).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT)


class Acceptor:
    """Minimal acyclic acceptors in one register: equal right languages are one state, whichever word list they came from."""

    def __init__(self):
        self.arcs: list[dict[str, int]] = [{}]  # state 0 accepts the empty word
        self.register: dict[tuple, int] = {(): 0}
        self.strings: dict[int, list[str]] = {0: [""]}
        self.shared: dict[tuple[int, int], list[str]] = {}

    def state(self, words: list[str], at: int = 0) -> int:
        """State of the right language of sorted, distinct ``words`` of one length from place ``at`` on."""
        if len(words[0]) == at:
            return 0
        if len(words) == 1:
            state = 0
            for label in reversed(words[0][at:]):
                state = self._registered(((label, state),))
            return state
        arcs, first = [], 0
        for i in range(1, len(words) + 1):
            if i == len(words) or words[i][at] != words[first][at]:
                arcs.append((words[first][at], self.state(words[first:i], at + 1)))
                first = i
        return self._registered(tuple(arcs))

    def _registered(self, key: tuple) -> int:
        found = self.register.get(key)
        if found is None:
            found = self.register[key] = len(self.arcs)
            self.arcs.append(dict(key))
        return found

    def language(self, q: int) -> list[str]:
        if q not in self.strings:
            self.strings[q] = [c + s for c, to in self.arcs[q].items() for s in self.language(to)]
        return self.strings[q]

    def common(self, p: int, q: int) -> list[str]:
        """Right language of the state pair (p, q) of the composition behind the edit."""
        if p == q:
            return self.language(p)
        pair = (p, q) if p < q else (q, p)
        found = self.shared.get(pair)
        if found is None:
            a, b = self.arcs[pair[0]], self.arcs[pair[1]]
            if len(b) < len(a):
                a, b = b, a
            found = self.shared[pair] = [c + s for c, to in a.items() if c in b for s in self.common(to, b[c])]
        return found

    def replaced(self, q: int, done: dict[int, list]) -> list[tuple[str, str]]:
        """Pairs of the right language of q that differ by one replaced code point."""
        if q not in done:
            arcs = list(self.arcs[q].items())
            out = [(c + x, c + y) for c, to in arcs if to for x, y in self.replaced(to, done)]
            for i, (a, p) in enumerate(arcs):
                for b, r in arcs[i + 1 :]:
                    out += [(a + s, b + s) for s in self.common(p, r)]
            done[q] = out
        return done[q]

    def inserted(self, p: int, q: int, at_end: bool, done: dict[tuple[int, int], list]) -> list[tuple[str, str]]:
        """Pairs of p's and q's right languages, the second with one code point more at the first difference."""
        if (p, q) not in done:
            left, right = self.arcs[p], self.arcs[q]
            out = [(c + x, c + y) for c, to in left.items() if c in right for x, y in self.inserted(to, right[c], at_end, done)]
            for b, to in right.items():
                out += [(s, b + s) for s in self.common(p, to) if (s[0] != b if s else at_end)]
            done[p, q] = out
        return done[p, q]


def accepted_pairs(words: list[str], m: int, lo: int, hi: int) -> Iterator[tuple[str, str]]:
    """Pairs one edit apart among words of m and m + 1 code points, the first difference in [lo, hi), one of them of m."""
    to = min(hi, m)
    groups: dict[tuple[str, str], tuple[list[str], list[str]]] = {}
    for w in words:  # one group, unless two states share a hash
        tail = len(w) - (m - to)
        groups.setdefault((w[:lo], w[tail:]), ([], []))[len(w) - m].append(w[lo:tail])
    for (head, tail), (short, long) in groups.items():
        if not short or len(short) + len(long) < 2:
            continue
        acceptor = Acceptor()
        p = acceptor.state(sorted(short))
        pairs = acceptor.replaced(p, {}) if len(short) > 1 else []
        if long:
            pairs = pairs + acceptor.inserted(p, acceptor.state(sorted(long)), hi > m, {})
        for x, y in pairs:
            yield head + x + tail, head + y + tail


def _enumerate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Accepted pairs of every partition, in both directions; rows come sorted by the partition's key."""

    def flush(parts):
        t = pa.Table.from_batches(parts)
        shape = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("key", "m", "lo", "hi")], axis=1)
        cuts = np.concatenate([[0], np.flatnonzero((shape[1:] != shape[:-1]).any(axis=1)) + 1, [len(shape)]])
        many = np.flatnonzero(np.diff(cuts) > 1)
        if not len(many):
            return None
        words, counts = t.column("word"), t.column("n").to_numpy()
        left, right, n_left, n_right = [], [], [], []
        for a, b in zip(cuts[many].tolist(), cuts[many + 1].tolist()):
            some = words.slice(a, b - a).to_pylist()
            n = dict(zip(some, counts[a:b].tolist()))
            for x, y in accepted_pairs(some, *shape[a, 1:].tolist()):
                left += (x, y)
                right += (y, x)
                n_left += (n[x], n[y])
                n_right += (n[y], n[x])
        return pa.RecordBatch.from_arrays(
            [pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(n_left, pa.int64()), pa.array(n_right, pa.int64())],
            names=["word", "near", "n", "near_n"],
        )

    held: list[pa.RecordBatch] = []  # the last key's rows so far: at most LIMIT and a batch
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if last or (held and held[-1].column(0)[0].as_py() != key[0]):
            out = flush([*held, batch.slice(0, last)])
            if out is not None:
                yield out
            held = []
        held.append(batch.slice(last))
    if held:
        out = flush(held)
        if out is not None:
            yield out


def _keyed(rows: DataFrame) -> DataFrame:
    """The partition's key: a hash of its initial state; words of different states are told apart again inside."""
    tail = "substring(word, length(word) - (m - least(hi, m)) + 1)"
    return rows.withColumn("key", F.expr(f"xxhash64(m, lo, hi, substring(word, 1, lo), {tail})")).select("key", "m", "lo", "hi", "word", "n")


def near_pairs(words: DataFrame, *, limit: int = LIMIT) -> DataFrame:
    """(word, near, n, near_n) of every two words one edit apart, in both directions; ``words`` has distinct word and n.

    Each word takes part with m its own length and one less.  No list of a
    partition beyond ``limit`` words is ever made: it is split by edit range.
    """
    ship(words.sparkSession)
    halves = "inline(flatten(transform(array(length(word), length(word) - 1), m -> array(struct(m as m, 0 as lo, m div 2 as hi), struct(m as m, m div 2 as lo, m + 1 as hi)))))"
    rows = _keyed(words.where("length(word) > 1").select("word", "n", F.expr(halves)).selectExpr("word", "n", "cast(m as int) m", "cast(lo as int) lo", "cast(hi as int) hi").where("lo < hi"))
    ready = []
    while True:
        rows = written(rows, "partitions")
        large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.col("hi") - F.col("lo")).alias("width"))
        large = written(large.where((F.col("size") > limit) & (F.col("width") > 1)).select("key"), "large")  # at most rows / limit
        if large.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(large, "key", "left_anti"))
        split = "inline(array(struct(lo as lo, (lo + hi) div 2 as hi), struct((lo + hi) div 2 as lo, hi as hi)))"
        rows = rows.join(large, "key", "left_semi").select("word", "n", "m", F.expr(split))
        rows = _keyed(rows.selectExpr("word", "n", "m", "cast(lo as int) lo", "cast(hi as int) hi"))
    every = ready[0]
    for more in ready[1:]:
        every = every.unionByName(more)
    return every.repartition("key").sortWithinPartitions("key", "m", "lo", "hi").mapInArrow(_enumerate, "word string, near string, n long, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by doubling: each step grows n by ``RATIO``, so chains are short and a few rounds end them."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, *, limit: int = LIMIT, ratio: int = RATIO, **how: int) -> DataFrame:
    """word, form, root, n, n_near, form_n of the vocabulary of all texts.

    Two words are near at exactly one inserted, deleted or replaced code point.
    ``form`` is the near word of largest n (ties: the smallest in code-point
    order) where that n is ``ratio`` times the word's own or more; ``root``
    follows forms to the last.  Null, empty or short texts give no words; a null
    doc_id reads as the empty string in the hash; repeated rows count again; an
    empty table gives no rows; other columns are not read.
    """
    words = written(vocabulary(docs, **how), "vocabulary")
    with shuffles_freed(docs.sparkSession):
        # The least (-n, word): the largest n, then the smallest word.
        pairs = near_pairs(words, limit=limit)
        near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best"))
        near = written(near.select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.minus")).alias("form_n")), "near")
    joined = words.join(near, "word", "left")
    close = F.col("form_n") >= ratio * F.col("n")
    named = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(close, F.col("form")).alias("form"), F.when(close, F.col("form_n")).alias("form_n")
    )
    named = written(named, "named")
    root = _roots(named.where("form is not null"))
    return named.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
