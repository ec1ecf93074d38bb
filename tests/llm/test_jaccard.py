import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import common, jaccard


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def set_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets, parent = [set_of(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in lists[x]).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        for x in s:
            lists[x].append(i)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        smallest[root(i)] = min(smallest.get(root(i), d), d)
    return sorted((d, len(sets[i]), smallest[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n=250):
    """Texts with copies, chains of near copies, shared passages, and many at the very threshold."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=30))
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 4, 5, 6, 9, 20, 60, 200]))) for _ in range(n // 3)]
    while len(texts) < n:
        w = rng.choice(texts).split()
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.choice([0, 1])] = [rng.choice(vocabulary)] * rng.choice([0, 1, 2])
        texts.append(" ".join(w + ([passage] if rng.random() < 0.2 else [])))
    return [(i * 7 % 1009, t.upper() if i % 3 else t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect())
    assert got == brute(rows)


def test_large_families_go_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(base[:40] + [f"x{i}"] + base[40:] if i % 2 else base[:-1] + [f"y{i}"])) for i in range(60)] + [(100, " ".join(rng.sample(base, 60)))]
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "BROADCAST_CLASSES", 0)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_bounds_lose_no_link():
    for n in range(1, 400):
        for m in range(n, 400):
            overlap = next(o for o in range(n + 1, -1, -1) if o <= n and (o == 0 or not jaccard.linked(o - 1, n, m))) if jaccard.linked(n, n, m) else None
            if overlap is None:
                break
            t = min(int(jaccard.occurrences(np.array(n))), int(jaccard.occurrences(np.array(m))))
            assert overlap >= (4 * m + 4) // 5 and n - overlap <= n // 5 and m - overlap <= m // 5
            assert max(int(jaccard.shared_at_least(np.array(n))), int(jaccard.shared_at_least(np.array(m)))) <= t <= overlap


def test_divide_skip_links_what_is_linked():
    rng = np.random.default_rng(4)
    for _ in range(30):
        base = rng.choice(1000, 50, replace=False)
        sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(35, 51), replace=False), rng.choice(1000, rng.integers(0, 6))])).astype(np.uint64) for _ in range(20)]
        links, _ = jaccard.divide_skip(sets)
        assert all(jaccard.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b])) for a, b in links)
        parent = list(range(20))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in links:
            parent[root(a)] = root(b)
        for a in range(20):
            for b in range(a):
                if jaccard.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b])):
                    assert root(a) == root(b)


@pytest.mark.parametrize("most", [0, 10_000])
def test_merging(monkeypatch, most):
    monkeypatch.setattr(jaccard, "HEAP", most)
    rng = np.random.default_rng(2)
    lists = [np.unique(rng.integers(0, 30, rng.integers(0, 12))) for _ in range(15)]
    entries, counts = jaccard.merged(lists)
    assert dict(zip(entries.tolist(), counts.tolist(), strict=True)) == Counter(x for own in lists for x in own.tolist())


@pytest.mark.parametrize("size", [1, 2, 3, 100])
@pytest.mark.parametrize("long", [3, 4096])
def test_lists_over_batches(monkeypatch, size, long):
    monkeypatch.setattr(jaccard, "LONG", long)
    rows = sorted([(t, c) for t, n in ((1, 1), (2, 2), (3, 9), (4, 1), (5, 4)) for c in range(n)] + [(3, 0), (5, 1), (4, 0)])
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array([5] * len(part), pa.int32())], names=["token", "class", "n"]) for i in range(0, len(rows), size) for part in [rows[i : i + size]]]
    out = [r for b in jaccard._lists(iter(batches)) for r in b.to_pylist()]
    df = {2: 2, 3: 9, 5: 4}
    assert sorted((r["token"], r["class"], r["df"]) for r in out) == sorted((t, c, min(n, long)) for t, n in df.items() for c in range(n))


def test_odd_rows(odd, none):
    rows = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(odd).collect()}
    assert {(1, 6, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (None, 6, None)} <= rows and jaccard.join(odd).count() == odd.count()
    assert jaccard.join(none).count() == 0 and jaccard.deduplicate(none).count() == 0
    kept = jaccard.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), *((False, i) for i in range(2, 9)), (True, 0)]


def test_one_of_each_group_stays(spark):
    rows = corpus(5)
    kept = [r.doc_id for r in jaccard.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept) == sorted({c for _, _, c in brute(rows)})


def test_large_families_with_parts_apart(spark, monkeypatch):
    """Two large groups of near copies and single texts between them, in one family."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(11)
    base = [f"b{i}" for i in range(100)]
    other = base[:60] + [f"c{i}" for i in range(40)]
    rows = [(i, " ".join((base if i % 2 else other)[:-1] + [f"x{i}"])) for i in range(60)]
    for i in range(100, 140):
        w = list(base)
        for _ in range(rng.randint(1, 25)):
            w[rng.randrange(100)] = f"z{rng.randrange(10)}"
        rows.append((i, " ".join(w)))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)
    members = spark.createDataFrame([(1, i, len(set_of(t)), sorted(hash(x) & (2**62 - 1) for x in set_of(t))) for i, t in rows], "family long, class long, n long, shingles array<long>")
    with common.Scratch(spark) as scratch:
        label = {r["class"]: r.label for r in jaccard.label_members(jaccard._with_blocks(members), scratch).collect()}
    want = {d: c for d, _, c in brute(rows)}
    assert label.keys() == want.keys()
    assert all((label[a] == label[b]) == (want[a] == want[b]) for a in want for b in want)


@pytest.mark.parametrize("own, phrase", [(9, 5), (60, 40)])
def test_a_common_phrase_makes_no_large_family(spark, own, phrase):
    """Texts that share a phrase and nothing else: short ones, and longer ones most of which it is."""
    words, n = " ".join(f"p{i}" for i in range(phrase)), 20_000 if own < 20 else 5000
    texts = spark.range(n).selectExpr("id AS doc_id", f"concat('{words} ', array_join(transform(sequence(1, {own}), k -> concat('o', id, 'x', k)), ' ')) AS text")
    copies = texts.where("doc_id < 3").selectExpr("doc_id + 100000 AS doc_id", "concat(text, ' more') AS text")
    docs = texts.unionByName(copies)
    with common.Scratch(spark) as scratch:
        sizes = [r["count"] for r in jaccard.members_of(docs, jaccard._rows(docs), scratch).groupBy("family").count().collect()]
    assert sizes == [2, 2, 2] and {r.component_id for r in jaccard.join(docs).where("doc_id >= 100000").collect()} == {0, 1, 2}


def test_ties_among_rows_with_one_id(spark):
    text = "one two three four five six seven"
    rows = [(5, text, "fr", {"k": 1}), (5, text, None, {"k": 2}), (5, text, "en", None), (5, text + " eight nine", "aa", None), (7, text, "aa", None), (9, "other words", "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, extra map<string,int>")
    for parts in (1, 4):
        got = jaccard.deduplicate(docs.repartition(parts)).collect()
        kept = [r for r in got if r.text == text]
        assert len(got) == 3 and len(kept) in (0, 1) and all(r.lang is None for r in kept)
        assert len({tuple(map(str, r)) for r in got}) == 3
