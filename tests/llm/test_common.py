import re

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import common
from quillon.llm.graph import components

TEXTS = ["The cat  sat\n", "", None, "ÉTÉ été x-1", "a" * 50, " \x0b\x0c ", "the", "cat sat the"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("kind, pattern", [(common.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (common.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words(kind, pattern):
    words = common.find_words(*common.text_bytes(pa.array(TEXTS, pa.string())), kind)
    expected = [re.findall(pattern, lower(t)) for t in TEXTS]
    assert np.diff(words.bounds()).tolist() == [len(w) for w in expected]
    flat = [w for own in expected for w in own]
    by_hash = {}
    for h, w in zip(words.hashes.tolist(), flat, strict=True):
        assert by_hash.setdefault(h, w) == w
    assert len(by_hash) == len(set(flat))


def test_words_longer_than_a_block(monkeypatch):
    texts = ["ab " * 100 + "x" * 300 + " tail", "ab"]
    want = common.find_words(*common.text_bytes(pa.array(texts))).hashes
    monkeypatch.setattr(common, "BLOCK", 64)
    got = common.find_words(*common.text_bytes(pa.array(texts))).hashes
    assert (want == got).all()


def test_sliced_columns():
    column = pa.array(TEXTS, pa.string()).slice(3, 3)
    assert common.text_bytes(column)[0].tobytes().decode() == "".join(TEXTS[3:6])
    assert list(common.text_parts(pa.array(["a" * 10] * 4 + ["b" * 100]), 25)) == [(0, 2), (2, 4), (4, 5)]


def test_rolled_stays_in_a_text():
    words = common.find_words(*common.text_bytes(pa.array(["a b c", "b c", "d"])))
    hashes, at = common.rolled(words.hashes, words.doc, 2)
    assert at.tolist() == [0, 1, 3] and hashes[1] == hashes[2] != hashes[0]


def test_fresh(spark):
    assert common.fresh(spark.range(1).selectExpr("id AS X", "id AS _x"), "x") == "__x"


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 30), (30, 100), (7, 7), (200, 201), (300, 20)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in [*range(21), 300]}, 30: 30, 100: 30, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
