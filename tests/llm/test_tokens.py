import random

import pytest
from tokenizers import Tokenizer

from quillon.llm import tokens


@pytest.fixture(scope="module")
def both():
    with open(tokens.tokenizer_path(), encoding="utf-8") as f:
        text = f.read()
    return Tokenizer.from_str(text), tokens.Counter(text)


def test_plain_pattern_splits_as_the_library(both):
    library, _ = both
    splitter, pattern = library.pre_tokenizer, tokens.plain_pattern()
    for a, b in tokens.PLAIN:
        for c in map(chr, range(a, b + 1)):
            text = f"a{c}1{c}-{c} {c}{c}  {c}'s"
            assert [text[i:j] for _, (i, j) in splitter.pre_tokenize_str(text)] == pattern.findall(text), repr(c)


def test_proven_strings_are_one_token(both):
    library, counter = both
    assert len(counter.whole) > 40_000
    for pre in random.Random(1).sample(sorted(counter.whole), 3000):
        if tokens.plain_pattern().findall(pre) == [pre]:
            assert len(library.encode(pre).ids) == 1


def test_counts_equal_the_library(both):
    library, counter = both
    rng = random.Random(2)
    alphabet = ["the ", "of", " ", "\n", "é", "ß", "漢字", "👍🏽", "123", "'ll", "<|endoftext|>", "<|endo", "\t", "x" * 9, "​", "ـ", "!!"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(600)] + ["<|endoftext|>", "", "a <|endoftext|><|endoftext|>b "]
    assert [counter.count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_memory_is_bounded(both, monkeypatch):
    _, counter = both
    monkeypatch.setattr(tokens, "MEMORY", 10)
    counter.count(" ".join(f"qz{i}x" for i in range(500)))
    assert len(counter.counts) <= len(counter.whole) + 12


def test_documents_and_odd_rows(both, spark, sf, odd, none):
    library, _ = both
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs).collect()}
    want = {r.doc_id: (len(r.text.encode()), n := len(library.encode(r.text).ids), n > 512) for r in docs.collect()}
    assert got == want
    out = tokens.count_tokens(odd)
    assert out.count() == odd.count() and out.where("doc_id IN (2, 3) AND n_tokens = 0 AND n_bytes = 0").count() == 2
    assert tokens.count_tokens(none).count() == 0
