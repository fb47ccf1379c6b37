"""Personal data: direct identifiers by pattern, and terms that reveal them by corpus co-occurrence.

A protected entity is a found e-mail address, IP address, card or phone number.
Its contexts are the ``CONTEXT`` characters on each side; equal contexts count
once, at their first document, so copies are no evidence.  With N documents,
df(e) with a counted context of entity e, df(t) that hold term t, and co(t, e)
with t in a counted context of e,

    disclosure(t, e) = PMI(t; e) / IC(e) = log2(co N / (df(t) df(e))) / log2(N / df(e))

is the share of e's information that t gives away: 1 if t occurs near e only.
An entity in every document has no information to give away.
Terms with ``SUPPORT`` co-occurrences or more are removed from ``REMOVE`` on and
generalised from ``GENERALISE`` on, in every document.  All of it is DataFrame
operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.quality import _let
from faultline.llm.shared import id_or_least, written

CONTEXT, SUPPORT, GENERALISE, REMOVE = 96, 3, 0.8, 0.95
BUCKETS = 1 << 16
FOLD = 256
SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"
_LOCAL, _DOMAIN = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
# A run is entered at its first character or where the last match ended, so no pattern rescans a long run.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
KINDS = tuple(PATTERNS)
TERM = r"[\p{L}\p{N}]+"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.rlike(m, F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
    if kind == "card":
        return _let(_digits(m), lambda d: F.when(F.length(d).between(13, 19), F.call_function("luhn_check", d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _located(text: Column, pattern: str, kind: str, valid) -> Column:
    """Spans of all leftmost matches that pass: gaps and matches alternate, so their lengths give the places."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g"))), lambda x: x["m"].isNotNull())

    def span(at: Column, x: Column) -> Column:
        start = at + F.length(x["g"])
        found = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("value"))
        return F.when(valid(x["m"]), F.array(found)).otherwise(F.expr(f"cast(array() as {SPANS})"))

    return _scanned(pairs, lambda at, x: at + F.length(x["g"]) + F.length(x["m"]), span, SPANS)


def _scanned(items: Column, advance, emit, out: str) -> Column:
    """Arrays that ``emit(position, item)`` gives, end to end; ``advance`` moves the position from 0 past each item.

    Spark's fold copies an array it appends to, so items are folded in blocks
    of ``FOLD`` and only the blocks' starts are gathered over all of them.
    """
    none = F.expr("cast(array() as array<int>)")
    first = F.struct(F.lit(0).alias("at"), none.alias("all"))

    def starts(blocks: Column) -> Column:
        step = lambda acc, b: F.struct(F.aggregate(b, acc["at"], advance).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))
        return F.aggregate(blocks, first, step, lambda acc: acc["all"])

    def folded(b: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.expr(f"cast(array() as {out})").alias("out"))
        step = lambda acc, x: F.struct(advance(acc["at"], x).alias("at"), F.concat(acc["out"], emit(acc["at"], x)).alias("out"))
        return F.aggregate(b, start, step, lambda acc: acc["out"])

    return _let(items, lambda all_: _let(_blocks(all_), lambda blocks: F.flatten(F.zip_with(blocks, starts(blocks), folded))))


def _blocks(items: Column) -> Column:
    """Consecutive items in arrays of ``FOLD``; ``items`` is a bound variable."""
    first = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(FOLD))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(first, lambda i: F.slice(items, i, FOLD))


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value) by kind, then start; code points, end exclusive."""
    none = F.expr(f"cast(array() as {SPANS})")
    parts = []
    for kind in KINDS:
        gate = F.contains(text, F.lit("@")) if kind == "email" else F.rlike(text, F.lit(GATES[kind]))
        parts.append(F.when(gate, _located(text, PATTERNS[kind], kind, lambda m, k=kind: _valid(k, m))).otherwise(none))
    return F.concat(*parts)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.array_distinct(F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda t: t != "")), F.lower))


def _entity(span: Column) -> Column:
    value = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), value)


def _contexts(text: Column, spans: Column) -> Column:
    """(entity, context) of each span; a block of spans is cut from the text once, as each cut counts code points from the start."""

    def around(s: Column, low: Column, piece: Column) -> Column:
        at, end = s["start"] - low, s["end"] - low
        left = F.substring(piece, F.greatest(at - CONTEXT, F.lit(0)) + 1, F.least(at, F.lit(CONTEXT)))
        left = F.when(s["start"] > CONTEXT, F.regexp_replace(left, rf"^{TERM}", "")).otherwise(left)  # no part of a word
        right = F.substring(piece, end + 1, F.lit(CONTEXT))
        right = F.when(F.length(right) == CONTEXT, F.regexp_replace(right, rf"(?<![\p{{L}}\p{{N}}]){TERM}$", "")).otherwise(right)
        return F.struct(_entity(s).alias("entity"), F.concat(left, F.lit(" \n "), right).alias("context"))

    def block(b: Column) -> Column:
        low = F.greatest(F.array_min(F.transform(b, lambda s: s["start"])) - CONTEXT, F.lit(0))
        high = F.array_max(F.transform(b, lambda s: s["end"])) + CONTEXT
        return _let(low, lambda lo: _let(F.substring(text, lo + 1, high - lo), lambda piece: F.transform(b, lambda s: around(s, lo, piece))))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    return _let(ordered, lambda all_: F.flatten(F.transform(_blocks(all_), block)))


def disclosing_terms(rows: DataFrame) -> DataFrame:
    """term, action (remove or generalise), disclosure of the corpus; ``rows`` has doc, key, text and spans."""
    near = rows.where(F.size("spans") > 0)
    found = near.select("doc", "key", F.explode(_contexts(F.col("text"), F.col("spans"))).alias("c")).select("doc", "key", "c.entity", "c.context")
    # Equal contexts are one, that of their first document.
    contexts = written(found.groupBy("entity", "context").agg(F.min(F.struct("doc", "key")).alias("at")), "contexts")
    pairs = contexts.select("entity", "at", F.explode(_terms(F.col("context"))).alias("term"))
    pairs = pairs.where(F.rlike("term", F.lit(r"\p{L}"))).distinct()  # bare numbers name too many things
    co = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("co")).where(F.col("co") >= SUPPORT)
    df_e = contexts.select("entity", "at").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("df_e"))
    co = written(co.join(df_e, "entity"), "cooccurrence")
    words = rows.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_t"))
    df_t = words.join(co.select("term").distinct(), "term")
    n = rows.count()
    scored = co.join(df_t, "term").where(F.col("df_e") < n)
    share = F.log2(F.col("co") * n / (F.col("df_t") * F.col("df_e"))) / F.log2(n / F.col("df_e"))
    best = scored.withColumn("disclosure", share).groupBy("term").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= GENERALISE)
    return best.withColumn("action", F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise"))


def _documents_with(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, key, term) of the documents that hold the terms.

    A table of at most ``BUCKETS`` hash values, whatever the corpus, drops most
    words where they are read; the exact join follows.
    """
    slot = F.pmod(F.xxhash64("term"), F.lit(BUCKETS))
    wanted = terms.select(slot.alias("slot")).distinct()
    words = rows.select("doc", "key", F.explode(_terms(F.col("text"))).alias("term"))
    near = words.withColumn("slot", slot).join(F.broadcast(wanted), "slot", "left_semi").drop("slot")
    return near.join(terms.select("term"), "term", "left_semi")


def _term_spans(text: Column, spans: Column, terms: Column) -> Column:
    """Places of the listed terms outside the spans found before."""
    hits = _located(text, TERM, "term", lambda m: F.array_contains(terms, F.lower(m)))
    free = lambda t: ~F.exists(spans, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    return F.filter(hits, free)


def _redacted(text: Column, spans: Column, removed: Column) -> Column:
    """The text with merged spans replaced by their kind; ``text`` is a column or bound variable."""
    label = lambda s: (
        F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        .when(F.array_contains(removed, F.lower(s["value"])), F.lit("[REMOVED]"))
        .when(F.rlike(s["value"], F.lit("^[0-9]+$")), F.lit("[NUMBER]"))
        .otherwise(F.lit("[TERM]"))
    )
    none = F.expr("cast(array() as array<string>)")
    end_of = lambda b: F.array_max(F.transform(b, lambda s: s["end"]))

    def block(b: Column, at0: Column) -> Column:
        """The labels of a block's spans and the text before each, from where the blocks before it end."""
        start = F.struct(at0.alias("at"), none.alias("out"))

        def cut(piece: Column) -> Column:
            def step(acc: Column, s: Column) -> Column:
                more = F.array(F.substring(piece, acc["at"] - at0 + 1, s["start"] - acc["at"]), label(s))
                return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"))

            return F.aggregate(b, start, step, lambda acc: acc["out"])

        return _let(F.substring(text, at0 + 1, F.greatest(end_of(b) - at0, F.lit(0))), cut)

    def whole(blocks: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all"))
        step = lambda acc, b: F.struct(F.greatest(acc["at"], end_of(b)).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))
        starts = F.aggregate(blocks, first, step, lambda acc: acc["all"])
        rest = F.substring(text, F.array_max(F.transform(blocks, end_of)) + 1, F.length(text))
        return F.concat(F.array_join(F.flatten(F.zip_with(blocks, starts, block)), ""), rest)

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    return _let(ordered, lambda o: F.when(F.size(o) == 0, text).otherwise(_let(_blocks(o), whole)))


def sanitise(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with ``_spans`` (kind, start, end, value) and ``_clean`` (the sanitised text).

    Spans are the base kinds in their order, then ``term``.  The cleaned text is
    scanned once more, so that digits set free by a replacement are not left.
    Null text: no spans, ``_clean`` null.  Null ids count as the smallest; rows
    that repeat an id are told apart by their text; equal rows get equal results.
    Columns named ``_spans`` and ``_clean`` are replaced; no other column is read.
    """
    docs = docs.drop("_spans", "_clean")
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"_c{i}") for i, c in enumerate(names)])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = plain.select(id_or_least().alias("doc"), F.xxhash64(text).alias("key"), text.alias("text"))
    found = rows.select("doc", "key", "text", base_spans(F.col("text")).alias("spans"))
    terms = written(disclosing_terms(found), "terms")
    holders = _documents_with(rows, terms).join(terms, "term")
    gone = F.collect_set(F.when(F.col("action") == "remove", F.col("term")))
    holders = written(holders.groupBy("doc", "key").agg(F.collect_set("term").alias("_terms"), gone.alias("_gone")), "holders")
    holders = holders.withColumnRenamed("doc", "_doc").withColumnRenamed("key", "_key")
    keyed = plain.withColumn("_body", text)
    same = (id_or_least() == F.col("_doc")) & (F.xxhash64("_body") == F.col("_key"))
    joined = keyed.join(holders, same, "left").drop("_doc", "_key")

    def all_spans(t: Column) -> Column:
        known = F.col("_terms")
        return _let(base_spans(t), lambda b: F.when(known.isNull(), b).otherwise(F.concat(b, _term_spans(t, b, known))))

    none = F.expr("cast(array() as array<string>)")
    spanned = joined.withColumn("_spans", all_spans(F.col("_body")))
    once = _redacted(F.col("_body"), F.col("_spans"), F.coalesce("_gone", none))
    again = _let(once, lambda t: _redacted(t, base_spans(t), none))
    clean = F.when(F.size("_spans") == 0, F.col("text").cast("string")).otherwise(again)
    back = [F.col(c if c in ("doc_id", "text") else f"_c{i}").alias(c) for i, c in enumerate(names)]
    return spanned.withColumn("_clean", clean).select(*back, "_spans", "_clean")


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def clean_texts(docs: DataFrame) -> DataFrame:
    """The rows with their text sanitised and all other columns unchanged."""
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"_c{i}") for i, c in enumerate(names)])
    done = sanitise(plain)
    return done.select(*[F.col("_clean").alias("text") if c == "text" else F.col(c if c == "doc_id" else f"_c{i}").alias(c) for i, c in enumerate(names)])
