import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import decontaminate as dc

RNG = random.Random(6)
WORDS = ["".join(RNG.choices("abcdefghij", k=4)) for _ in range(300)]
ITEMS = [(i, " ".join(RNG.choices(WORDS, k=RNG.randint(8, 40)))) for i in range(30)] + [(30, "tiny item"), (31, None), (32, " .. "), (33, None)]


def shingles(words):
    k = min(5, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(text, items):
    """Best window and similarity by item, weights as described."""
    import math

    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    own = {i: words(t) for i, t in items if words(t)}
    df = Counter(s for w in own.values() for s in shingles(w))
    weight = lambda s: math.log1p(len(own) / df[s]) if s in df else math.log1p(len(own))
    doc, out = words(text), {}
    for i, w in own.items():
        item, span, k = shingles(w), min(len(w), len(doc)), min(5, len(w))
        for start in range(len(doc) - span + 1):
            window = Counter(tuple(doc[j : j + k]) for j in range(start, start + span - k + 1))
            every = item.keys() | window.keys()
            total = sum(weight(s) * max(item[s], window[s]) for s in every)
            similarity = sum(weight(s) * min(item[s], window[s]) for s in every) / total if total else 0
            if similarity >= 0.8 and similarity > out.get(i, (0,))[0] + 1e-9:
                out[i] = (similarity, start)
    return out


def changed(text, edits):
    words = text.split()
    for _ in range(edits):
        words[RNG.randrange(len(words))] = "changed"
    return " ".join(words)


def test_finds_what_brute_force_finds():
    fill = lambda n: " ".join(RNG.choices(WORDS, k=n))
    texts = [f"{fill(RNG.randint(0, 60))} {changed(t, RNG.choice([0, 0, 1, 2]))}, {fill(RNG.randint(0, 40))}" for _, t in ITEMS[:30]]
    texts += [fill(200), "a TINY, Item!", ITEMS[3][1].upper().replace(" ", "! "), ITEMS[4][1].rsplit(" ", 1)[0], f"{ITEMS[5][1]} {ITEMS[6][1]} {ITEMS[5][1]}", "", None]
    index = dc.Items(ITEMS)
    got = {r: {m.item: (m.similarity, m.first_word) for m in own} for r, own in index.matches(pa.array(texts, pa.string()))}
    for r, text in enumerate(texts):
        want = brute(text, ITEMS)
        assert set(got.get(r, {})) == set(want)
        for i, (similarity, _) in want.items():
            assert abs(got[r][i][0] - similarity) < 1e-9


def flipped(prints, most):
    """Fingerprints with some bits changed."""
    out = prints.copy()
    for row in out:
        for bit in RNG.sample(range(dc.BITS), RNG.randint(0, most)):
            row[bit // 16] ^= np.uint16(1 << bit % 16)
    return out


def test_blocks_guarantee_the_radius():
    masks = set(dc.near_values(dc.RADIUS // dc.BLOCKS).tolist())
    for _ in range(2000):
        difference = sum(1 << b for b in RNG.sample(range(dc.BITS), dc.RADIUS))
        assert any(difference >> (16 * b) & 0xFFFF in masks for b in range(dc.BLOCKS))


def test_pairs_within_the_radius(monkeypatch):
    monkeypatch.setattr(dc, "WINDOWS", 16)
    index = dc.Items([(i, " ".join(RNG.choices(WORDS, k=20))) for i in range(50)])
    blocks = index.groups[5, 20]["blocks"]
    prints = flipped(blocks.prints, 40)
    got = {(w, i): d for w, i, d in blocks.within(prints)}
    distance = [[sum((int(x) ^ int(y)).bit_count() for x, y in zip(w, p, strict=True)) for p in blocks.prints] for w in prints]
    assert got == {(w, i): distance[w][i] for w in range(50) for i in range(50) if distance[w][i] <= dc.RADIUS}


def test_few_items_are_candidates_of_a_window():
    """Of other items' windows and of random ones: those near in some block, out of 300 items of one size."""
    items = [(i, " ".join(RNG.choices(WORDS, k=30))) for i in range(300)]
    blocks = dc.Items(items).groups[5, 30]["blocks"]
    others = dc.Items([(i, " ".join(RNG.choices(WORDS, k=30))) for i in range(300)]).groups[5, 30]["blocks"].prints
    pairs = sum(len(w) for w, _ in blocks.candidates(others))
    assert pairs < 0.12 * 300 * 300


def test_radius_leaves_out_next_to_nothing():
    """Of windows whose similarity is little above the threshold."""
    items = [(i, " ".join(RNG.choices(WORDS, k=60))) for i in range(200)]
    index, all_, lost = dc.Items(items), 0, 0
    for n, (_, text) in enumerate(items):
        for _ in range(10):
            words = text.split()
            words[RNG.randrange(5, 55)] = f"new{RNG.randrange(10**6)}"
            words[0 if RNG.random() < 0.5 else -1] = "end"
            _, window = dc.item_shingles(pa.array([" ".join(words)]))
            if 0.8 <= index.alike(window[0], index.shingles[n]) < 0.87:
                all_ += 1
                lost += int(np.bitwise_count(index.fingerprint(window[0]) ^ index.fingerprint(index.shingles[n])).sum()) > dc.RADIUS
    assert all_ > 500 and lost <= 0.01 * all_


def test_tables(spark, odd, none):
    text = ITEMS[0][1]
    docs = spark.createDataFrame([(1, f"x {text} y", "k"), (1, f"x {text} y", "k"), (2, "clean", "k"), (None, text, None), (3, None, None)], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = dc.find_matches(docs, benchmark)
    assert sorted((r.doc_id or 0, r.item_id, r.similarity) for r in out.collect()) == [(0, 0, 1.0), (1, 0, 1.0), (1, 0, 1.0)]
    kept = dc.clean(docs, benchmark)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert sorted(map(str, dc.find_matches(docs, benchmark, at_once=4).collect())) == sorted(map(str, out.collect()))
    assert dc.clean(docs, benchmark, at_once=4).count() == 2
    assert dc.find_matches(odd, benchmark).count() == 0 and dc.clean(odd, benchmark).count() == odd.count()
    assert dc.find_matches(none, benchmark).count() == 0 and dc.clean(docs, benchmark.limit(0)).count() == 5


def test_planted_passages_at_small_scale(spark, sf):
    from quillon.llm.queries import REGISTRY

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    plain = lambda t: " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower()))
    want = {(d, i) for d, t in docs.items() for i, x in items if f" {plain(x)} " in f" {plain(t)} "}
    got = {(r.doc_id, r.item_id) for r in REGISTRY.queries["op7_decontamination"](spark, sf).collect()}
    assert want and want <= got


@pytest.mark.parametrize("text", ["", None, "one two"])
def test_short_texts(text):
    assert list(dc.Items(ITEMS).matches(pa.array([text], pa.string()))) == []
