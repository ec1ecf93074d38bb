import copy

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import toxicity
from quillon.llm.common import find_words, text_bytes
from quillon.llm.features import LETTERS

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(spark, docs):
    return toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))


def test_gradients():
    net, rng = toxicity.Network(5, 3), np.random.default_rng(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, first, length, out = rng.normal(size=(20, 5)), np.array([0, 6, 11]), np.array([6, 5, 4]), np.array([1.0, -2, 0.5])
    loss = lambda: (net.run(net.project(x), first, length)[0] * out).sum()
    gates = net.project(x)
    _, trace = net.run(gates, first, length, keep=True)
    grads, d_gates = net.back(out, trace, gates, first, length)
    for d in "fb":
        grads[f"w{d}"], grads[f"s{d}"] = x.T @ d_gates[d], d_gates[d].sum(0)
    for name, p in net.p.items():
        flat = p.reshape(-1)
        for i in rng.integers(len(flat), size=3):
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss()
            flat[i] = old - 1e-3
            down = loss()
            flat[i] = old
            # States are held in 32 bits.
            assert abs((up - down) / 2e-3 - grads[name].reshape(-1)[i]) < 2e-3


def test_windows_cover_all_words():
    for n in (1, 31, 32, 33, 56, 57, 500):
        text, first, length = toxicity.windows_of(np.array([0, 0, n, n]))
        assert set(text) == {1} and (length >= 1).all() and (length[:-1] == toxicity.WINDOW).all()
        assert set(np.concatenate([np.arange(f, f + m) for f, m in zip(first, length, strict=True)])) == set(range(n))


def test_held_out_accuracy(spark, docs, model):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    hits = [r.predicted == r.toxic for r in rows]
    assert len(rows) > 800 and sum(hits) / len(hits) > 0.97
    assert sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_a_toxic_window_anywhere_in_a_text(spark, docs, model):
    clean = docs.where("doc_id = 1").first().text * 20
    at = len(clean) * 3 // 4
    rows = spark.createDataFrame([(1, clean), (2, clean[:at] + " you idiot moron stupid scum " + clean[at:])], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score(rows, model).collect()}
    assert got == {1: 0, 2: 1}


def test_odd_rows(spark, odd, none, model):
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(r.score == 0 and r.predicted == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert toxicity.score(none, model).count() == 0


@pytest.mark.parametrize("rows", [[], [(1, 1)], [(1, 0), (2, None)], [(1, 0), (1, 0), (7, 1), (None, 1)]])
def test_few_labels(spark, odd, rows):
    labels = spark.createDataFrame([(a, 1, b) for a, b in rows], "doc_id long, quality int, toxic int")
    out = toxicity.score(odd, toxicity.fit(odd, labels))
    assert out.count() == odd.count() and out.where("score IS NULL OR isnan(score)").count() == 0


def test_scores_equal_a_plain_loop_over_all_windows(spark, docs, model):
    """Each window of each text by itself, a step at a time, in doubles."""
    rows = docs.where("length(text) BETWEEN 50 AND 3000 AND doc_id % 250 = 3").limit(12).collect()
    got = {r.doc_id: r.score for r in toxicity.score(docs.where(docs.doc_id.isin([r.doc_id for r in rows])), model).collect()}
    p, h = {k: v.astype(float) for k, v in model.network.p.items()}, model.network.hidden
    logistic = lambda v: 1 / (1 + np.exp(-v))

    def logit(x):
        states = np.zeros((len(x), 2 * h))
        for d, order, at in (("f", range(len(x)), 0), ("b", reversed(range(len(x))), h)):
            state = np.zeros(h)
            for t in order:
                gate, back = x[t] @ p[f"w{d}"] + p[f"s{d}"], state @ p[f"u{d}"]
                z, r = logistic(gate[:h] + back[:h]), logistic(gate[h : 2 * h] + back[h : 2 * h])
                state = z * state + (1 - z) * np.tanh(gate[2 * h :] + r * back[2 * h :])
                states[t, at : at + h] = state
        weight = np.exp(np.tanh(states @ p["a"]) @ p["v"])
        return float((weight / weight.sum()) @ states @ p["o"] + p["c"][0])

    assert len(rows) > 5
    for r in rows:
        data, offsets = text_bytes(pa.array([r.text]))
        x = model.inputs(data, find_words(data, offsets, LETTERS)).astype(float)
        starts = [*range(0, max(1, len(x) - toxicity.WINDOW), toxicity.STRIDE), max(0, len(x) - toxicity.WINDOW)]
        want = max((logit(x[i : i + toxicity.WINDOW]) for i in starts), default=-np.inf)
        assert abs(got[r.doc_id] - logistic(want)) < 1e-4


def test_characters_carry_something(spark, docs, model):
    """Without the trained four-gram vectors held-out texts are told apart less well."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = docs.join(labels.where("toxic IN (0, 1)"), "doc_id")
    without = copy.deepcopy(model)
    without.gram_table[:, 1:] = 0
    hits = [sum(r.predicted == r.toxic for r in toxicity.score(held, m).where("held_out").join(labels, "doc_id").collect()) for m in (model, without)]
    assert hits[0] >= hits[1] + 4


def test_long_labelled_texts_are_learned_from(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("doc_id < 3000")
    long = docs.where("doc_id < 3000 AND length(text) BETWEEN 20 AND 2000").selectExpr("doc_id", "repeat(concat(text, ' '), CAST(20000 / length(text) AS INT) + 1) AS text")
    assert long.where(f"octet_length(text) <= {toxicity.MOST_BYTES}").isEmpty()
    rows = toxicity.score(long, toxicity.fit(long, labels)).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r.toxic == 1]
    assert len(toxic) > 5 and sum(r.predicted for r in toxic) >= 0.4 * len(toxic)
    assert sum(r.predicted == r.toxic for r in rows) > 0.9 * len(rows)


def test_stretches_come_from_all_over():
    assert toxicity.stretches(None) == "" and toxicity.stretches("a" * toxicity.MOST_BYTES) == "a" * toxicity.MOST_BYTES
    cut = toxicity.stretches("a" * 50_000 + "é" * 50_000 + "z" * 50_000)
    assert len(cut.encode()) <= toxicity.MOST_BYTES + toxicity.STRETCHES and {"a", "é", "z"} <= set(cut)
