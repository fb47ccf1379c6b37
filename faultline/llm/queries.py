"""Registered queries of the corpus operators and the DuckDB twins of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import decontaminate, language_id, packing, perspectives, phrases, privacy, quality, secret_scan, simhash, spelling, substrings, token_files, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = language_id.train(docs, ~held_out)
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(_table(spark, sf_dir, "documents"))
    return token_files.read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = warc.archive(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.sanitise(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = privacy.span_list(F.filter("_spans", lambda s: s["kind"] != "term"))
    return found.select("doc_id", *[count(k) for k in privacy.KINDS], F.sha2(base, 256).alias("base_sha256"), privacy.span_list(F.col("_spans")).alias("spans"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark(docs, _table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("_hit_items", lambda i: i.cast("string"))), ",")
    return marked.select(
        "doc_id", F.col("_n_words").alias("n_words"), decontaminate.n_hit().alias("n_hit"), F.size("_hit_items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"),
    )


def op10_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(_table(spark, sf_dir, "conversations"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("_secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = secret_scan.span_list(F.filter("_secrets", lambda s: s["kind"] != "literal"))
    return found.select("doc_id", *[count(k) for k in secret_scan.KINDS], F.sha2(base, 256).alias("base_sha256"), secret_scan.span_list(F.col("_secrets")).alias("spans"))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_token_files, op3_quality_rules, op4_simhash, op5_warc, op6_personal_data, op7_substring_dedup, op8_packing,
    op9_decontamination, op10_perspectives, op11_spelling_variants, op12_phrase_collocations, op13_secret_scans,
)}

ORACLES = {
    "op5_warc": """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as n, sha256(html) as h from p),
f as (select h, min(page_id) as first from d where n >= 100 group by h)
select d.page_id, d.n as payload_bytes, d.h as payload_digest,
       case when f.first <> d.page_id then 'revisit' else 'response' end as record_type,
       case when f.first <> d.page_id then f.first end as refers_to
from d left join f on d.h = f.h and d.n >= 100
""",
    "op10_perspectives": """
with t as (select conv_id, turn, role, coalesce(text, '') as text from conversations),
w as (select * from t where conv_id is not null and turn is not null and role is not null),
s as (select distinct conv_id, role as perspective from w where role <> 'system'),
x as (
  select w.conv_id, s.perspective, w.turn, w.role, w.text from w join s using (conv_id)
  union all
  select conv_id, null, turn, role, text from t where conv_id is null or turn is null or role is null),
c as (select *, case when role = 'system' then 'system' when role = perspective then 'assistant' else 'user' end as chat_role from x),
n as (select *, case when chat_role = 'user' then coalesce(role, 'unknown') end as name from c),
h as (select *, '<|im_start|>' || chat_role || coalesce(' name=' || name, '') || chr(10) as head from n),
r as (select *, head || text || '<|im_end|>' || chr(10) as rendered from h),
o as (select *, sum(length(rendered)) over (partition by conv_id, perspective order by turn, role, text rows unbounded preceding)::bigint as upto,
             row_number() over (partition by conv_id, perspective, turn order by role, text) - 1 as place from r)
select conv_id, perspective, turn, case when perspective is null then 0 else place end as part, chat_role, name, rendered,
       case when chat_role = 'assistant' then 1 else 0 end as loss,
       case when perspective is null then 0 else upto - length(rendered) end::bigint as start,
       case when perspective is null then length(rendered) else upto end::bigint as end_, length(head)::bigint as header
from o
""",
    "op3_quality_rules": f"""
with t as (select doc_id, row_number() over () as row_id, coalesce(text, '') as text from documents),
w as (select *, list_filter(string_split_regex(text, '[ \\x09-\\x0D]+'), lambda x: x <> '') as words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) as lines from t),
g as (select row_id, i, array_to_string(words[i:i + 4], ' ') as gram from w, unnest(range(1, len(words) - 3)) as u(i)),
k as (select row_id, i from (select *, count(*) over (partition by row_id, gram) as n from g) where n > 1),
v as (select row_id, sum(least(5, i - before)) as n from (select row_id, i, lag(i, 1, -4) over (partition by row_id order by i) as before from k) group by row_id),
m as (select doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
             (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(v.n, 0)::bigint as n_repeat_words, len(lines) as n_lines,
             len(string_split(text, chr(10))) - len(lines) as n_blank,
             len(list_filter(words, lambda x: lower(x) in ({", ".join(repr(x) for x in quality.STOP_WORDS)}))) as n_stop
      from w left join v using (row_id)),
b as (select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and word_chars / greatest(n_words, 1) between 2.0 and 20.0 and n_symbols / greatest(word_chars, 1) <= 0.1
       and n_dup_lines / greatest(n_lines, 1) <= 0.5 and (n_words < 50 or n_stop / greatest(n_words, 1) >= 0.02)
       and n_blank / greatest(n_lines + n_blank, 1) <= 0.9 as kept
from b
""",
    "op11_spelling_variants": """
with recursive bits as (select i, list_reduce([i::ubigint] || list_transform(range(8), lambda x: 0::ubigint),
    lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) as v from range(256) t(i)),
table_ as (select list(v order by i) as crc from bits),
runs as (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{C0}-\\x{FF}]+')) as raw from documents),
low as (select id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from runs where length(raw) >= 7),
hexed as (select run, hex(encode(id || ':' || run)) as x from low),
bytes as (select run, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::ubigint) as b from hexed),
hashed as (select run, xor(list_reduce([4294967295::ubigint] || b, lambda c, y: xor(c >> 8, crc[(xor(c, y) & 255)::bigint + 1])), 4294967295::ubigint) as h from bytes, table_),
cutw as (select case when h % 31 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word from hashed),
v as (select word, count(*) as n from cutw where length(word) >= 7 group by word having count(*) >= 2),
dels as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as d from (select word, n, unnest(range(length(word))) as i from v)),
near as (
  select a.word, b.word as other, b.n as other_n from dels a join dels b on a.i = b.i and a.d = b.d and a.word <> b.word
  union select a.word, b.word, b.n from dels a join v b on a.d = b.word
  union select b.word, a.word, a.n from dels a join v b on a.d = b.word),
best as (select word, count(*) as n_near, max(other_n) as top from near group by word),
named as (
  select v.word, v.n, coalesce(best.n_near, 0)::bigint as n_near, case when top >= 10 * v.n then top end as form_n,
         case when top >= 10 * v.n then (select min(other) from near where near.word = v.word and other_n = top) end as form
  from v left join best on v.word = best.word),
walk as (
  select word, word as at, form as next from named
  union all select walk.word, walk.next, named.form from walk join named on walk.next = named.word)
select n.word, n.form, w.at as root, n.n, n.n_near, n.form_n from named n join walk w on n.word = w.word and w.next is null
""",
    "op12_phrase_collocations": """
with p as (select coalesce(lang, 'und') as lang, row_number() over () as doc, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') as pieces from documents),
q as (select lang, doc, unnest(range(len(pieces))) as piece, unnest(pieces) as body from p),
w as (select lang, doc, piece, list_filter(string_split_regex(body, '[ \\x09]+'), lambda x: x <> '') as words from q),
n as (select lang, sum(len(words))::bigint as n from w group by lang),
g as (select lang, words[i:i + k - 1] as g, k, count(*)::bigint as a
      from (select lang, words, k, unnest(range(1, len(words) - k + 2)) as i from w, range(1, 6) as r(k)) group by all),
f as (select * from g where a >= 100),
c as (select * from f where k > 1),
inner_ as (select lang, g[1:k - 1] as g, a from c where k > 2 union all select lang, g[2:k], a from c where k > 2),
covered as (select lang, g, max(a) as widest from inner_ group by all),
kept as (select c.* from c left join covered using (lang, g) where widest is null or 100 * widest < 100 * a),
cuts as (select lang, g, k, a, unnest(range(1, k)) as cut from kept),
s as (select cuts.*, l.a as l, r.a as r, n.n, ((1000::hugeint * cuts.a * n.n) // (l.a::hugeint * r.a))::bigint as score
      from cuts join n using (lang) join f l on l.lang = cuts.lang and l.g = cuts.g[1:cut] join f r on r.lang = cuts.lang and r.g = cuts.g[cut + 1:cuts.k]),
o as (select *, row_number() over (partition by lang, g order by score, cut) as place from s),
t as (select lang, array_to_string(g, ' ') as phrase, a, l, r, n, score from o where place = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from t)
select lang, rank, phrase, a, l, r, n, score from ranked where rank <= 2000
""",
}
