import itertools

import numpy as np
import pytest

from quillon.llm import language


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return language.fit(docs)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 8])
def test_forward_backward_equals_enumeration(n, monkeypatch):
    monkeypatch.setattr(language, "CHUNK", 3)
    rng = np.random.default_rng(n)
    scores, moves = rng.normal(size=(n + 2, 3)), rng.normal(size=(3, 3))
    marginals, pairs = language.forward_backward(scores, moves, np.array([0, n, n, n + 2]))
    want_pairs = np.zeros((3, 3))
    for a, b in ((0, n), (n, n + 2)):
        want, total, own = np.zeros((b - a, 3)), 0.0, np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=b - a):
            w = np.exp(sum(scores[a + i, p] for i, p in enumerate(path)) + sum(moves[p, q] for p, q in zip(path, path[1:], strict=False)))
            total += w
            for i, p in enumerate(path):
                want[i, p] += w
            for p, q in zip(path, path[1:], strict=False):
                own[p, q] += w
        assert np.allclose(marginals[a:b], want / total)
        want_pairs += own / total
    assert np.allclose(pairs, want_pairs)


def test_held_out_accuracy(docs, model):
    got = language.identify(docs, model)
    joined = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(joined) > 150
    assert sum(r.lang_pred == r.lang for r in joined) / len(joined) > 0.96
    assert all(0 <= r.score <= 1 for r in joined)


def test_other_columns_are_no_inputs(docs, model):
    changed = docs.selectExpr("doc_id + 1000 AS doc_id", "text", "'xx' AS lang", "'y' AS source")
    a = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    b = {r.doc_id - 1000: (r.lang_pred, r.score) for r in language.identify(changed, model).collect()}
    assert a == b


def test_words_of_a_mixed_text_get_their_languages(model):
    import pyarrow as pa

    from quillon.llm.common import find_words, text_bytes

    text = "thatth the and ing ofthe wher anerth the of and to is that with " + "éauoui le la des et queaux pour dans une que elle aux "
    data, offsets = text_bytes(pa.array([text * 2]))
    words = find_words(data, offsets, language.LETTERS)
    labels = [model.languages[i] for i in model.marginals(model.scores(model.features(data, words), words), words.bounds()).argmax(1)]
    assert labels[2] == "en" and labels[18] == "fr" and len(set(labels)) >= 2


def test_odd_rows(odd, none, model):
    rows = language.identify(odd, model).collect()
    assert len(rows) == odd.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (2, 3, 4, 6))
    assert {r.lang_pred for r in rows if r.doc_id == 1} == {"en"}
    assert language.identify(none).count() == 0
    assert all(r.lang_pred == "und" for r in language.identify(odd.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")).collect())


def test_kept_rows(odd, model):
    kept = language.keep_known(odd, model)
    assert kept.schema == odd.schema
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 5, 7, 8]


def test_long_texts_and_rare_languages_are_learned(spark, docs):
    """Only texts above any bound, and a language of which there are few rows."""
    some = docs.where("lang IN ('en', 'fr') AND length(text) > 200").selectExpr("doc_id", "repeat(concat(text, ' '), CAST(80000 / length(text) AS INT) + 1) AS text", "lang")
    rare = docs.where("lang = 'de' AND length(text) > 400").orderBy("doc_id").limit(40).selectExpr("doc_id", "text", "lang")
    got = language.identify(rows := some.unionByName(rare), language.fit(rows, 60)).join(rows, "doc_id").where("held_out").collect()
    assert {r.lang for r in got} == {"en", "fr", "de"} and sum(r.lang_pred == r.lang for r in got) > 0.9 * len(got)


def test_middles_are_bounded():
    assert language.middle(None) == "" and language.middle("1 2 !") == ""
    assert language.middle("ab, cd.") == "ab, cd"
    assert len(language.middle("x" * 100_000).encode()) == language.MOST_BYTES
    assert len(language.middle("word " * 10_000).split()) == language.WORDS
