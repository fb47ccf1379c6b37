"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import SPACE_CLASS

REPEAT_WINDOW = 5
SYMBOL_CLASS = r"[#*$%&|<>]"
# Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "au", "aux", "avec", "ce", "dans", "de", "du", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "con", "del", "el", "en", "las", "lo", "los", "no", "para", "por", "se", "su", "una", "y",
)


@dataclass(frozen=True)
class Rule:
    """A ratio must lie in [least, most]; ``over`` words at least, below which the ratio says nothing."""

    ratio: str
    least: float | None = None
    most: float | None = None
    over: int = 0


#: The threshold table.
RULES = (
    Rule("mean_word_length", least=2.0, most=20.0),
    Rule("symbol_ratio", most=0.1),
    Rule("dup_line_ratio", most=0.5),
    Rule("stop_word_ratio", least=0.02, over=50),
    Rule("blank_line_ratio", most=0.9),
)


def _let(value: Column, body) -> Column:
    """Bind a value once: a lambda variable is not evaluated again at each use."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def _repeated(words: Column) -> Column:
    """Words that lie in a 5-word window found twice or more in the text.

    Windows are compared by a 64-bit hash within one text.  If all are distinct
    nothing is sorted; else equal neighbours in hash order mark their places, and
    the places, in text order, cover min(5, gap to the next) words each.
    """
    k = REPEAT_WINDOW

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def places(s: Column) -> Column:
            twin = F.filter(s, lambda p, i: (F.get(s, i - 1)["x"] == p["x"]) | (F.get(s, i + 1)["x"] == p["x"]) & (i < F.size(s)))
            return F.array_sort(F.transform(twin, lambda p: p["i"]))

        start = F.struct(F.lit(-k).alias("at"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(k), i - acc["at"])).alias("n"))
        return F.aggregate(_let(placed, places), start, step, lambda acc: acc["n"])

    return F.when(F.size(words) < k, F.lit(0).cast("long")).otherwise(count(words))


def measured(text: Column) -> Column:
    """Struct of the counts of one whole text (null: empty)."""

    def of(t: Column) -> Column:
        return _let(words_of(t), lambda w: _let(F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))), lambda filled: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.size(F.split(t, SYMBOL_CLASS)) - 1).cast("long").alias("n_symbols"),
            (F.size(filled) - F.size(F.array_distinct(filled))).cast("long").alias("n_dup_lines"),
            _repeated(w).alias("n_repeat_words"),
            F.size(filled).cast("long").alias("n_lines"),
            (F.size(F.split(t, "\n")) - F.size(filled)).cast("long").alias("n_blank_lines"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        )))

    return _let(F.coalesce(text.cast("string"), F.lit("")), of)


def verdict(m: str = "m") -> tuple[Column, Column]:
    """(base_failed, kept) from a measured struct column."""
    n = F.col(f"{m}.n_words")
    share = lambda a, b: F.col(f"{m}.{a}") / F.greatest(b, F.lit(1))
    lines = F.col(f"{m}.n_lines")
    ratios = {
        "mean_word_length": share("word_chars", n),
        "symbol_ratio": share("n_symbols", F.col(f"{m}.word_chars")),
        "dup_line_ratio": share("n_dup_lines", lines),
        "stop_word_ratio": share("n_stop_words", n),
        "blank_line_ratio": share("n_blank_lines", lines + F.col(f"{m}.n_blank_lines")),
    }
    base = (n < 10) | (100 * F.col(f"{m}.n_repeat_words") > 20 * n)
    good = ~base
    for r in RULES:
        value = ratios[r.ratio]
        inside = F.lit(True)
        inside = inside & (value >= r.least) if r.least is not None else inside
        inside = inside & (value <= r.most) if r.most is not None else inside
        good = good & ((n < r.over) | inside)
    return base, good


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row, in one scan without a shuffle.

    Null and empty texts have no words and fail.  Rows are judged one by one:
    ties, repeated rows and null ids need no rule; other columns are not read.
    """
    m = docs.select(F.col("doc_id"), measured(F.col("text")).alias("m"))
    base, kept = verdict()
    return m.select("doc_id", "m.*", base.alias("base_failed"), kept.alias("kept"))
