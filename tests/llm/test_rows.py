"""Rows without ids, rows that share one, clashing names, few labels and special tokens."""

import numpy as np
import pyarrow as pa
import pytest

from faultline.llm import language_id, privacy, simhash, substrings, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def unlike(n, seed=1):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{x}" for x in rng.integers(0, 10**9, 40)) for _ in range(n)]


def test_near_duplicates_keep_rows_without_or_with_one_id(spark):
    texts = unlike(33)
    rows = [(None, t, "en", "s", 1) for t in texts[:30]] + [(7, t, "en", "s", 1) for t in texts[30:]]
    rows += [rows[0], (9, texts[31], "en", "other", 2), (7, texts[31], "en", "same id and text", 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(t for _, t in got) == sorted(texts) and dict((t, i) for i, t in got)[texts[31]] == 7


def test_near_duplicates_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d", 5, 6), (2, "a b c d", 7, 8)], "doc_id long, text string, _doc long, _key long")
    assert [tuple(r) for r in simhash.keep_one(docs).collect()] == [(1, "a b c d", 5, 6)]


def test_repeats_leave_texts_without_ids_alone(spark):
    plain = unlike(200, seed=2)
    loops = [" ".join([f"v{i}x{j}" for j in range(25)] * 2) for i in range(200)]
    docs = spark.createDataFrame([(None, t, "en", "s", 1) for t in plain + loops], SCHEMA)
    removed = [r.n_removed for r in substrings.remove_repeats(docs).collect()]
    assert sorted(removed) == [0] * 200 + [25] * 200


@pytest.mark.parametrize("n", [2, 10, 49, 60])
def test_few_labels_are_calibrated(spark, n):
    rng = np.random.default_rng(n)
    words = {"en": ["the", "house", "walks", "light"], "fr": ["été", "maison", "où", "arbre"]}
    rows = [(i, " ".join(rng.choice(words["en" if i % 2 else "fr"], 30)), "en" if i % 2 else "fr", "s", 1) for i in range(n)]
    model = language_id.train(spark.createDataFrame(rows, SCHEMA))
    assert 0 < model.threshold <= 0.5
    lang, score = model.predict(pa.array([t for _, t, *_ in rows]))
    assert np.mean([a == r[2] for a, r in zip(lang, rows)]) > 0.9 and (score <= 1).all()


def test_cost_of_language_follows_bytes():
    counts = list(language_id.subword_counts(pa.array(["ab cd", "", None, "x" * 100_000])))
    assert len(counts) == 4 and not len(counts[1][0]) and not len(counts[2][0])
    assert counts[3][1].sum() == 3 * 100_000 - 6 and counts[3][1].max() > 65_535


def test_special_tokens_are_read_as_the_library_reads_them():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.default_vocabulary())
    rng = np.random.default_rng(3)
    parts = ["a", "é", " ", "  ", "\n", "<|endoftext|>", "'s", "don't", "***", "1", "_", "word", "日本", "🙂", "’", "it'", "."]
    texts = ["hello <|endoftext|> world", "word***", "word***,"] + ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(2000)]
    ids, cuts = tokens.PieceEncoder(tokens.default_vocabulary()).encode(pa.array(texts), None)
    for i, t in enumerate(texts):
        assert ids[cuts[i] : cuts[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids


def test_many_spans_in_one_text(spark):
    n = 3000
    text = "start " + " ".join(f"u{i}@ex.com" for i in range(n)) + " end"
    docs = spark.createDataFrame([(1, text, "b", 1, "t"), (2, None, "b", 2, "t")], "doc_id long, text string, _body string, _key int, _terms string")
    got = {r.doc_id: r for r in privacy.sanitise(docs).collect()}
    assert list(got[1].asDict()) == ["doc_id", "text", "_body", "_key", "_terms", "_spans", "_clean"]
    assert [(s.start, s.end) for s in got[1]["_spans"]] == [(text.index(f"u{i}@"), text.index(f"u{i}@") + len(f"u{i}@ex.com")) for i in range(n)]
    assert got[1]["_clean"] == "start " + " ".join(["[EMAIL]"] * n) + " end" and got[2]["_clean"] is None


def test_disclosure_counts_documents(spark):
    rows = [(i, f"mail bob{i % 3}@ex.com about zebra{i % 3} now number {i}") for i in range(30)] + [(100 + i, f"plain text about now {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = docs.selectExpr("doc_id as doc", "xxhash64(text) as key", "text").withColumn("spans", privacy.base_spans(docs.text))
    got = {r.term: r for r in privacy.disclosing_terms(spans).collect()}
    assert set(got) == {"zebra0", "zebra1", "zebra2"} and all(r.disclosure == pytest.approx(1.0) and r.action == "remove" for r in got.values())
