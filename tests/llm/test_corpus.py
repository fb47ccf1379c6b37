"""The corpus operators against brute-force versions, round trips and held-out labels, on small planted tables."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultline.llm import decontaminate, language_id, packing, perspectives, privacy, quality, simhash, substrings, token_files, tokens, warc
from faultline.llm.shared import PLAIN_WORD, Words, text_chunks

SPACE = r"[^\x20\x09-\x0D]+"
PASSAGE = " ".join(f"shared{i % 23}x{i}" for i in range(60))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, key string, h int"


def corpus():
    """Nulls, blanks, copies, near copies, a hot passage, a very long text and clashing columns."""
    rng = np.random.default_rng(5)
    words = {"en": ["the", "of", "and", "house", "tree", "walk", "light"], "fr": ["le", "de", "été", "maison", "arbre", "où"]}
    rows = [(None, "the end of the house"), (1, None), (2, ""), (3, " \n\t "), (4, "...!!"), (5, "one"), (6, "é"), (6, "é")]
    for i in range(10, 90):
        lang = "en" if i % 3 else "fr"
        body = [f"{rng.choice(words[lang])}{rng.integers(0, 40) if rng.random() < 0.5 else ''}" for _ in range(int(rng.integers(3, 120)))]
        if i % 4 == 0:
            at = int(rng.integers(0, len(body)))
            body[at:at] = PASSAGE.split()
        rows.append((i, " ".join(body) + ("\nline two" if i % 5 == 0 else "")))
    copies = [(200 + i, rows[20][1]) for i in range(25)] + [(300 + i, rows[21][1] + f" tail{i}") for i in range(25)]
    long = (500, " ".join(f"w{i % 977} v{i % 991}" for i in range(20_000)))
    rows += [*copies, long, (200, rows[20][1])]
    return [(k, t, "fr" if k and 10 <= k < 90 and k % 3 == 0 else None if k in (5, 6) else "en", "s", 0, "x", "y", 1) for k, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_words_and_windows():
    texts = ["a b  a b", None, "", "b", "x\ty z"]
    [(_, n, data, offsets)] = text_chunks(pa.array(texts))
    w = Words(data, offsets, PLAIN_WORD)
    assert w.counts.tolist() == [4, 0, 0, 1, 2] and n == 5
    assert w.hash[0] == w.hash[2] and w.hash[1] == w.hash[3] == w.hash[4] and len(set(w.hash.tolist())) == 4
    two = w.window(2)
    assert two[0] == two[2] and two[0] != two[1]


# language identification


def test_language_id(docs, none):
    model = language_id.train(docs.where("doc_id between 10 and 80"))
    found = language_id.identify(docs, model)
    assert found.columns == ["doc_id", "lang_pred", "score", "rejected"] and found.count() == len(corpus())
    got = {r.doc_id: r for r in found.collect()}
    for k in (1, 2, 3, 4):
        assert got[k].lang_pred == "und" and got[k].score == 0 and got[k].rejected
    real = {k: lang for k, t, lang, *_ in corpus() if k and 10 <= k < 90}
    right = sum(got[k].lang_pred == v for k, v in real.items())
    assert right / len(real) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language_id.keep_known(docs, model)
    assert kept.columns == docs.columns
    assert rows_of(kept, "doc_id", "text") == rows_of(docs.join(found.where("not rejected").select("doc_id").distinct(), docs.doc_id.eqNullSafe(found.doc_id), "left_semi"), "doc_id", "text")
    empty = language_id.train(none)
    assert {r.lang_pred for r in language_id.identify(docs, empty).collect()} == {"und"} and language_id.identify(none, empty).count() == 0


def test_language_model_rejects_by_calibration():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    x = rng.poisson(0.2, (400, language_id.BUCKETS))
    x[y == 0, :50] += 3
    x[y == 1, 50:100] += 3
    m = language_id.fit([(np.flatnonzero(r), r[r > 0]) for r in x], y, ["a", "b"])
    doc, bucket = (np.repeat(i, x[x > 0]) for i in np.nonzero(x))
    p = m.probabilities(len(x), doc, bucket)
    assert (p.argmax(axis=1) == y).mean() > 0.97 and 0 < m.threshold <= 0.5


# token files


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 0), (1, 1 << 62), (5000, 3), (5000, 1 << 40), (2000, 1500)):
        v = np.sort(rng.integers(0, top + 1, n).astype(np.uint64))
        ef = token_files.EliasFano.encode(v)
        back = token_files.EliasFano.decode(ef.n, ef.l, ef.bits, ef.parts())
        assert (back.all() == v).all() and all(back.select(i) == v[i] for i in range(0, n, 37))
        if n >= 2000:
            assert 8 * len(ef.parts()) < n * (3 + max(0, np.log2((top + 1) / n)) + 0.2)
    with pytest.raises(IndexError):
        back.select(5000)


def test_pieces_encode_as_the_library():
    coder = tokens.encoder(tokens.default_vocabulary())
    texts = [None, "", " ", "  ", "a  b", "a \n b", "x\n\ny", "it's we'll  'tis", "Ünïcödé wörds, déjà.", "  a b", "tab\t end ", "<|endoftext|> 1,234.5", "日本 語", "end\n", "a.\nB c.\nD"]
    ids, cuts = coder.encode(pa.array(texts), 0)
    for k, t in enumerate(texts):
        want = coder.tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        assert ids[cuts[k] : cuts[k + 1]].tolist() == want, t
    coder.reset()
    again, _ = coder.encode(pa.array(texts), 0)
    assert (again == ids).all()


def test_a_start_is_never_taken_for_a_piece_after_a_space():
    coder = tokens.PieceEncoder(tokens.default_vocabulary())
    texts = ["a \0x", "x y"]
    ids, cuts = coder.encode(pa.array(texts), None)
    assert [ids[cuts[k] : cuts[k + 1]].tolist() for k in (0, 1)] == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_table_of_pieces_holds_a_word_once(monkeypatch):
    words = ["".join("abcdefghij"[int(c)] for c in str(n)) for n in range(100_000, 140_000)]
    coder = tokens.PieceEncoder(tokens.default_vocabulary())
    coder.encode(pa.array(["warm up"]), 1)
    tracemalloc.start()
    first, _ = coder.encode(pa.array([" ".join(words)]), 1)
    held = tracemalloc.get_traced_memory()[0] - first.nbytes
    tracemalloc.stop()
    assert held < 250 * len(words)  # 400 bytes a word with a second table
    monkeypatch.setattr(tokens, "CACHE_PIECES", 1000)
    assert (coder.encode(pa.array([" ".join(words)]), 1)[0] == first).all() and coder.n <= len(words) + 2
    coder.encode(pa.array(["a few words"]), 1)
    assert coder.n < 10


def test_token_files_round_trip(docs, none):
    manifest = token_files.write_token_files(docs)
    back = token_files.read_token_files(manifest).orderBy("start").collect()
    coder = tokens.encoder(tokens.default_vocabulary()).tokenizer
    want = sorted(((-(1 << 63) if k is None else k), t or "") for k, t, *_ in corpus())
    at = 0
    for r, (k, t) in zip(back, want, strict=True):
        ids = np.array(coder.encode(t, add_special_tokens=False).ids + [0], "<u4")
        assert (r.doc_id if r.doc_id is not None else -(1 << 63)) == k and r.start == at and bytes(r.ids) == ids.tobytes() and r.n_tokens == len(ids)
        at += len(ids)
    shard = token_files.TokenShard(manifest.orderBy("shard").first().path)
    a, b = shard.bounds(shard.n_docs - 1)
    assert b == shard.n_ids and len(shard.ids(a, b)) == b - a and shard.doc_id(0) is None
    assert token_files.read_token_files(token_files.write_token_files(none)).count() == 0


# quality rules


def test_quality_against_brute_force(docs, none):
    extra = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame(
        [(900, "a b c d e f a b c d e x a b c d e"), (901, "a a a a a a a a a a a"), (902, "#*$ |\n#*$ |\n\n#"), (903, "% " * 30 + "the of"), (904, "x" * 500)], "doc_id long, text string"))
    for r, g in zip(extra.orderBy("doc_id", "text").collect(), quality.judge(extra.orderBy("doc_id", "text")).collect(), strict=True):
        text = r.text or ""
        w = re.findall(SPACE, text)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        twice = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if re.search(SPACE, x)]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice)), r.doc_id
        assert g.base_failed == (len(w) < 10 or 100 * len(twice) > 20 * len(w)) and not (g.base_failed and g.kept)
    assert quality.judge(none).count() == 0


# SimHash


def brute_components(fps):
    u = np.array(sorted(set(fps)), np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= simhash.RADIUS
    label = np.arange(len(u))
    while not ((new := np.where(near, label[None, :], len(u)).min(axis=1)) == label).all():
        label = new
    return dict(zip(u.tolist(), label.tolist()))


def test_simhash_components(docs, none):
    from xxhash import xxh64_intdigest

    got = simhash.components(docs).collect()
    assert len(got) == len(corpus())
    text = {}
    for k, t, *_ in corpus():
        text[k] = t or ""

    def fingerprint(t):
        w = re.findall(SPACE.encode(), t.encode().lower())
        if not w:
            return 0
        grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        bits = [xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in bits) > len(bits))

    short = [r for r in got if r.doc_id != 500]
    assert all(int(r.fingerprint, 16) == fingerprint(text[r.doc_id]) for r in short)
    label = brute_components([int(r.fingerprint, 16) for r in got])
    least = {}
    for r in got:
        c = label[int(r.fingerprint, 16)]
        k = -(1 << 63) if r.doc_id is None else r.doc_id
        least[c] = min(least.get(c, k), k)
    for r in got:
        assert (-(1 << 63) if r.component_id is None else r.component_id) == least[label[int(r.fingerprint, 16)]]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(least)
    assert simhash.components(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_simhash_broadcasts_no_generated_rows(spark, monkeypatch):
    """Tables that Spark takes for small by their files hold 2 to 34 rows for each of theirs once exploded."""
    plans, write = {}, simhash.written

    def noted(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(simhash, "written", noted)
    fps = spark.range(2000).selectExpr("xxhash64(id) as fp")
    assert simhash.link_edges(simhash.written(fps, "unique")).count() == 0
    assert all("SortMergeJoin" in plans[k] and "BroadcastHashJoin" not in plans[k] for k in ("segments", "probes"))


@pytest.mark.parametrize("cold, tile", [(48, 1024), (4, 64), (100_000, 10)])
def test_simhash_links_in_dense_groups(spark, monkeypatch, cold, tile):
    monkeypatch.setattr(simhash, "COLD", cold)
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(2)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 100)}
    for centre in list(fps)[:3]:
        for _ in range(250):
            v = centre
            for b in rng.choice(64, int(rng.integers(0, 6)), replace=False):
                v ^= 1 << int(b)
            fps.add(v)
    edges = simhash.link_edges(spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long"))
    got = {r.node & ((1 << 64) - 1): r.label for r in simhash.connected_components(edges).collect()}
    want = brute_components(fps)
    pairs = {(want[x], got.get(x, ("alone", x))) for x in fps}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


# WARC


def test_warc_round_trip_and_index(spark):
    big, rows = "<p>" + "x" * 200, []
    for i in range(60):
        rows.append((i, f"http://www.h{i % 4}.example.com/p/{i % 7}#f", big if i % 3 == 0 else f"<html>{i} é", "z"))
    rows += [(60, None, None, "z"), (61, "http://a.b/\r\nx", "", "z"), (None, "http://a.b/", "y" * 100, "z"), (62, "http://a.b/", "y" * 100, "z"), (63, "http://a.b", "y" * 99, "z"), (64, "http://a.b", "y" * 99, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(5)
    manifest = warc.write_archives(pages)
    for fan_in, width in ((32, 100_000), (2, 9)):
        index = warc.merge_index(manifest, fan_in=fan_in, range_captures=width)
        keys = [(r.url_key, r.captured, r.page_id) for r in index.orderBy("part", "place").collect()]
        assert keys == sorted(keys) and len(keys) == len(rows)
        got = {r.page_id: r for r in warc.read_archives(index).collect()}
        for k, url, html, _ in rows:
            raw, r = (html or "").encode(), got[k]
            assert r.payload_bytes == len(raw) and r.payload_digest == hashlib.sha256(raw).hexdigest()
            same = [-1 if j is None else j for j, _, h, _ in rows if (h or "").encode() == raw]
            first = min(same) == (-1 if k is None else k)
            if len(raw) < 100 or first:
                assert r.record_type == "response" and r.refers_to is None and bytes(r.payload) == raw
            else:
                assert r.record_type == "revisit" and (-1 if r.refers_to is None else r.refers_to) == min(same)
    records, index = warc.archive(pages.limit(0))
    assert records.count() == 0 and index.count() == 0


def test_loser_tree():
    rng = np.random.default_rng(3)
    for k in (0, 1, 2, 5, 8, 13):
        lists = [sorted((int(x), "a", i) for x in rng.integers(0, 20, int(rng.integers(0, 15)))) for i in range(k)]
        assert list(warc.LoserTree([iter(x) for x in lists])) == sorted(e for x in lists for e in x)


# personal data

RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in RAW.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and luhn(d)
                    or kind == "phone" and 9 <= len(d) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_and_leaks(spark, docs, none):
    rng = np.random.default_rng(4)
    bits = ["1", "2.", ".", "@", "a", "b.c", "+4", "9", "4111 1111 1111 1111", "é", "😀", " ", "-", "255", "256", "(", "x@y.z", "_w", "%", "0", "12345678", "10.0.0.1"]
    texts = ["".join(rng.choice(bits, int(rng.integers(0, 15)))) for _ in range(1500)] + [None, "1" * 100_000, "a." * 30_000 + "@", "+1(" * 20_000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    found = privacy.sanitise(rows).withColumn("s", privacy.span_list(F.col("_spans"))).collect()
    assert len(found) == len(texts)
    for r in found:
        assert [s for s in r.s.split(",") if s and not s.startswith("term")] == brute_spans(r.text or ""), r.text
        assert not brute_spans(r["_clean"] or "") and (r["_clean"] is None) == (r.text is None)
    assert privacy.clean_texts(none).count() == 0
    same = privacy.clean_texts(docs)
    assert same.columns == docs.columns and rows_of(same, "doc_id", "text", "kept") == rows_of(docs, "doc_id", "text", "kept")


def test_terms_that_reveal_an_entity(spark):
    """``zorro`` stands by one address only and goes everywhere; ``mail`` stands by many, ``alone`` has one context in many copies."""
    rows = [(i, f"w{i} letter {i} from Zorro at zorro@example.com to v{i} today") for i in range(6)]
    rows += [(20 + i, f"some mail u{i} to p{i}@example.com and more") for i in range(30)]
    rows += [(1060 + i, f"plain mail text {i} the letter today to you") for i in range(120)]
    rows += [(100, "nobody knows that Zorro, is here"), (101, None)]
    rows += [(110 + i, "alone stands by q@example.org here") for i in range(9)]
    got = {r.doc_id: r for r in privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got[100]["_clean"] == "nobody knows that [REMOVED], is here"
    assert got[100]["_spans"][0].kind == "term" and got[100]["_spans"][0].start == 18
    assert got[1060]["_clean"] == got[1060].text and got[110]["_clean"] == "alone stands by [EMAIL] here"
    assert "mail" in got[20]["_clean"] and got[101]["_clean"] is None


# substring removal


def brute_removed(rows, window=20):
    first, cut = {}, {}
    for k, t in sorted(rows):
        w = re.findall(SPACE, t)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (k, i))
    for k, t in rows:
        w = re.findall(SPACE, t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (k, i):
                gone[i : i + window] = [True] * window
        cut[k] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return cut


@pytest.mark.parametrize("window", [20, 6])
def test_repeats_against_brute_force(docs, none, window):
    got = substrings.remove_repeats(docs, window).collect()
    assert len(got) == len(corpus())
    want = brute_removed([(-(1 << 63) if k is None else k, t or "") for k, t, *_ in corpus()], window)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_text) == want[-(1 << 63) if r.doc_id is None else r.doc_id], r.doc_id
    assert sum(r.n_removed for r in got) > 1000 and substrings.remove_repeats(none).count() == 0


# packing


def test_packing_keeps_every_id_and_pads_nothing(docs, none):
    got = packing.pack(docs, size=256).collect()
    coder = tokens.encoder(tokens.default_vocabulary()).tokenizer
    want = Counter()
    for k, t, *_ in corpus():
        want[k, tuple(coder.encode(t or "", add_special_tokens=False).ids + [1])] += 1
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
        assert len(r.ids) == 4 * r.length
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0, *(r.length for r in s)])[:-1].tolist()
        total = sum(r.length for r in s)
        assert total == s[0].sequence_length and (total == 256 or total & (total - 1) == 0) and total <= 256
    whole = Counter()
    for k, ps in pieces.items():
        ids = sum(r.length for r in ps)
        assert ids == sum(len(i) * n for (d, i), n in want.items() if d == k)
        if sum(n for (d, _), n in want.items() if d == k) == 1:
            ps.sort(key=lambda r: r.start)
            flat = tuple(np.frombuffer(b"".join(bytes(r.ids) for r in ps), "<u4").tolist())
            assert want[k, flat] == 1 and ps[0].doc_tokens == len(flat)
            whole[k] += 1
    assert len(whole) > 100 and packing.pack(none).count() == 0


def test_hilbert_curve_is_one_path():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert_key(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# decontamination


def fold(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("block", [2_000_000, 20])
def test_decontamination_against_brute_force(spark, docs, none, block):
    items = [(1, PASSAGE.upper()), (2, " ".join(PASSAGE.split()[10:25])), (3, "line, TWO"), (4, None), (5, "..."), (None, "house"), (7, "nowhere seen words"), (2, "w1 v1 w2-v2"), (10, "w1 v1 w2-v2")]
    bench = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, size int")
    windows = defaultdict(set)
    for k, t in items:
        w = fold(t)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(k)
    sizes = {len(w) for w in windows}
    got = decontaminate.mark(docs, bench, block_windows=block).select("doc_id", "text", "_n_words", decontaminate.n_hit().alias("n"), "_hit_items", decontaminate.contaminated().alias("c")).collect()
    assert len(got) == len(corpus())
    for r in got:
        w, seen = fold(r.text), set()
        hit = [False] * len(w)
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    seen |= windows[tuple(w[i : i + n])]
                    hit[i : i + n] = [True] * n
        assert (r["_n_words"], r.n, r["_hit_items"]) == (len(w), sum(hit), sorted(seen - {None}))
        assert r.c == (sum(hit) > 0 and 20 * sum(hit) >= len(w))
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and rows_of(clean, "doc_id", "text") == sorted(((r.doc_id, r.text) for r in got if not r.c), key=repr)
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == len(corpus()) and decontaminate.mark(none, bench).count() == 0


# perspectives


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "cy", "yo"), (1, 3, "ann", "tie"), (1, 3, "ann", "tie"), (None, 1, "ann", "x"), (2, None, "ann", "x"), (2, 0, None, "x"), (3, 0, "system", "s")]
    rows += [(9, t, "ab"[t % 2], f"text {t}") for t in range(3000)]
    turns = spark.createDataFrame([(*r, "n") for r in rows], "conv_id long, turn long, role string, text string, name string").repartition(4)
    got = perspectives.rotate(turns).collect()
    whole = [r for r in rows if None not in r[:3]]
    talkers = {(c, r) for c, _, r, _ in whole if r != "system"}
    assert len(got) == 3 + sum((c, p) in talkers for c, *_ in whole for p in {r for k, _, r, _ in whole if k == c})
    for c, p in talkers:
        mine = sorted((r for r in got if (r.conv_id, r.perspective) == (c, p)), key=lambda r: (r.turn, r.part))
        at = 0
        for r, (_, turn, role, text) in zip(mine, sorted((w for w in whole if w[0] == c), key=lambda w: (w[1], w[2], w[3] or "")), strict=True):
            kind = "system" if role == "system" else "assistant" if role == p else "user"
            head = f"<|im_start|>{kind}" + (f" name={role}" if kind == "user" else "") + "\n"
            assert (r.turn, r.chat_role, r.loss, r.start, r.header) == (turn, kind, int(role == p), at, len(head))
            assert r.rendered == head + (text or "") + "<|im_end|>\n"
            at += len(r.rendered)
            assert r.end_ == at
    assert perspectives.rotate(turns.limit(0)).count() == 0


# the pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    base = [(k, t, lang, s, n) for k, t, lang, s, n, *_ in corpus() if k is None or k < 200]
    base += [(700, "the house and the tree wrote to jo@example.com of light " + " ".join(f"walk{i}" for i in range(40)), "en", "s", 0), (701, PASSAGE, "en", "s", 0), (702, base[30][1], "en", "s", 0)]
    spark.createDataFrame(base, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == before.columns
        seen.append({r.doc_id: r.text for r in docs.collect()})
    known, unique, clean, safe = seen
    assert not {1, 2, 3, 4} & set(known) and 700 in known
    assert 702 not in unique and 701 not in clean and 700 in clean
    assert "jo@example.com" not in safe[700] and "[EMAIL]" in safe[700] and set(safe) == set(clean)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    coder = tokens.encoder(tokens.default_vocabulary()).tokenizer
    assert {r.doc_id for r in pieces} == set(safe)
    for k, t in safe.items():
        ids = np.array(coder.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes()
        assert zlib.crc32(b"".join(bytes(r.ids) for r in sorted((r for r in pieces if r.doc_id == k), key=lambda r: r.start))) == zlib.crc32(ids)
