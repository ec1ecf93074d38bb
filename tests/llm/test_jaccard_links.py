from itertools import combinations

import numpy as np
import pyarrow as pa

from quillon.llm import jaccard


def test_all_links_of_a_group_are_counted(spark, monkeypatch):
    """A chain of near copies whose ends aren't linked, in one block and in several."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([f"x{i}" for i in range(n)] + words[n:]) for n in range(8)] + [" ".join(words)] * 2 + ["other words here", "", None]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in ((t or "").split() for t in texts)]
    alike = lambda a, b: bool(a | b) and 100 * len(a & b) >= 80 * len(a | b)
    want = dict.fromkeys(range(len(texts)), 0)
    for i, j in combinations(want, 2):
        for at in (i, j):
            want[at] += alike(sets[i], sets[j])
    assert sum(want.values()) > 2 * (len(texts) - 1) and want[0] < 9
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (1500, 3):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        rows = jaccard.count_links(docs).collect()
        assert len(rows) == len(texts) and {r.doc_id: r.n_links for r in rows} == want


def test_query_equals_its_oracle(spark, sf):
    import __spark_entry__ as entry
    from oracle import compare

    assert compare(entry.queries()["jaccard_links"](spark, sf), entry.oracle_sql()["jaccard_links"], sf) > 0


def some_sets(rng):
    """Sets near a few others, some equal in size, of one shingle up to sixty."""
    base = [rng.integers(0, 10**6, rng.integers(1, 60)).astype(np.uint64) for _ in range(4)]
    for _ in range(50):
        one = base[rng.integers(len(base))].copy()
        at = rng.integers(0, len(one), rng.integers(0, len(one) // 4 + 1))
        one[at] = rng.integers(0, 10**6, len(at)).astype(np.uint64)
        yield np.unique(one)


def test_partners_are_those_of_enumeration(monkeypatch):
    rng = np.random.default_rng(3)
    for marked in (4096, 3):
        monkeypatch.setattr(jaccard, "MARKED", marked)
        for _ in range(10):
            sets = list(some_sets(rng))
            for side in (None, rng.integers(0, 2, len(sets))):
                want = {(i, j) for i, j in combinations(range(len(sets)), 2) if (side is None or side[i] != side[j]) and jaccard.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
                got = [(min(i, j), max(i, j)) for j, p in jaccard.all_partners(sets, side) for i in p.tolist()]
                assert len(got) == len(set(got)) and set(got) == want


def test_a_task_counts_links_without_giving_pairs():
    """A hundred near copies: a row a class comes out, not one of 4,950 pairs."""
    sets = [np.append(np.arange(40), 1000 + k).astype(np.int64) for k in range(100)]
    n = len(sets)
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([7] * n, [0] * n, [0] * n, [0] * n, range(n), range(1, n + 1))] + [pa.array(sets, pa.list_(pa.int64()))], names=["family", "i", "j", "own", "class", "copies", "shingles"])
    out = pa.Table.from_batches(jaccard._counted(iter([batch.slice(0, 30), batch.slice(30)]))).to_pylist()
    assert len(out) == n and all(r["others"] == n * (n + 1) // 2 - (r["class"] + 1) for r in out)
