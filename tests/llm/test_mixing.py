import math
from collections import Counter
from hashlib import md5

import pytest

from quillon.llm import mixing


def draw(doc_id, rate, seed=mixing.SEED):
    u = int(md5(f"{seed}|{'' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    k, p, total = 0, math.exp(-rate), math.exp(-rate)
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def docs(spark, n):
    return spark.createDataFrame([(i, f"t{i}", "big" if i % 10 else "small") for i in range(n)], "doc_id long, text string, source string")


def test_copies_are_the_inverse_of_the_distribution(spark):
    out = mixing.mix(docs(spark, 400), {"big": 1.0, "small": 3.0}, total=600.0).collect()
    rates = {"big": 600 * 0.25 / 360, "small": 600 * 0.75 / 40}
    got = Counter(r.doc_id for r in out)
    assert {i: got.get(i, 0) for i in range(400)} == {i: draw(i, rates["big" if i % 10 else "small"]) for i in range(400)}
    assert all(1 <= r.copy <= r.n_copies == got[r.doc_id] for r in out)
    assert abs(sum(1 for r in out if r.source == "small") / len(out) - 0.75) < 0.08


def test_large_rates_and_the_joined_way(spark, monkeypatch):
    few = docs(spark, 10)
    out = mixing.mix(few, {"small": 1.0}, total=2000.0)
    assert {r.source for r in out.select("source").distinct().collect()} == {"small"}
    assert 1700 < out.count() < 2300
    monkeypatch.setattr(mixing, "MOST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix(docs(spark, 100)).collect())) == sorted(map(tuple, mixing.mix(docs(spark, 100)).collect()))


def test_shuffled(spark):
    order = [r.doc_id for r in mixing.mix(docs(spark, 200)).collect()]
    assert order != sorted(order)


def test_odd_rows(odd, none):
    out = mixing.mix(odd)
    assert set(odd.columns) <= set(out.columns) and out.columns.count("copy") == 1
    assert dict(out.dtypes)["copy"] == "int"
    assert mixing.mix(none).count() == 0
    assert mixing.mix(odd, {None: 1.0}, total=50.0).where("source IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd, {"a": -1.0})


def test_rows_without_id_go_by_their_text(spark):
    rows = [(None, f"text {i}", "en", "a", 1) for i in range(400)] + [(None, None, None, "a", None), (7, "x", "en", "a", 1)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    texts = [r.text for r in out.where("doc_id IS NULL").collect()]
    assert 200 < len(set(texts)) < 320 and 300 < len(texts) < 500
    assert out.select("shuffle_key").distinct().count() == out.count()
