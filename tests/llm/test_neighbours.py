import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.llm import common, neighbours


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(ids, x, k=20):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x[i] * x).sum(1)
        order = np.lexsort((ids, -s))
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order if j != i][:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, want):
    return np.mean([len({a for a, _ in got[q]} & {a for a, _ in own}) / max(1, len(own)) for q, own in want.items()])


def test_recall_over_many_lists(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "WHOLE", 100)
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2, size=(3000, 1)) + 2 * rng.normal(size=(12, 16))[rng.integers(12, size=3000)]).astype(np.float32)
    ids = np.arange(3000)
    got = found(neighbours.search(frame(spark, [(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)])))
    want = brute(ids, x.astype(np.float64))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9
    for q, own in got.items():
        assert all(abs(s - float((x[q].astype(np.float64) * x[v]).sum())) < 1e-9 for v, s in own)
        assert own == sorted(own, key=lambda p: (-p[1], p[0])) and q not in {v for v, _ in own}


def test_copies_and_ties(spark):
    rows = [(i, [1.0, 0.0] if i < 100 else [0.5, float(i % 3)], 1) for i in range(130)]
    got = found(neighbours.search(frame(spark, rows)))
    assert got == brute(np.arange(130), np.array([r[1] for r in rows]))


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [1.0, 2.0, 3.0], 1), (8, [2.0, 1.0], None), (None, [1.0, 1.0], 1), (20, None, 1), (40, [0.0, 0.0], 1), (8, [2.0, 1.0], None)]
    assert found(neighbours.search(frame(spark, rows))) == {0: [(8, 4.0)]}
    assert neighbours.search(frame(spark, [])).count() == 0
    assert neighbours.search(frame(spark, [(20, [1.0, 1.0], 1)])).count() == 0


def test_hot_lists_go_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 16)
    monkeypatch.setattr(neighbours, "PART", 4)
    monkeypatch.setattr(neighbours, "HELD", 50)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4)).astype(np.float32)
    got = found(neighbours.search(frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])))
    want = brute(np.arange(200), x.astype(np.float64))
    assert {q: [v for v, _ in own] for q, own in got.items()} == {q: [v for v, _ in own] for q, own in want.items()}


def test_graph_finds_near_centroids():
    rng = np.random.default_rng(5)
    c = np.concatenate([rng.normal(size=(40, 8)) * 0.1 + 5 * rng.normal(size=8) for _ in range(6)])
    graph = neighbours.CentroidGraph(c)
    found, wanted = 0, 0
    for q in rng.normal(size=(100, 8)) * 4:
        d = ((c - q) ** 2).sum(1)
        got, want = graph.search(q, 1.1), set(np.flatnonzero(d <= d.min() * 1.21).tolist())
        assert got[0] == d.argmin() and (np.diff(d[got]) >= 0).all()
        found, wanted = found + len(want & set(got.tolist())), wanted + len(want)
    assert found >= 0.97 * wanted


def test_lists_are_balanced():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(3000, 8)) * 0.3, rng.normal(size=(1000, 8)) + 3])
    c = neighbours.balanced_centroids(x, 20)
    sizes = np.bincount(neighbours.distances(x, c).argmin(1), minlength=20)
    assert sizes.max() < 4 * 200
    at, lists = neighbours.lists_of(x, c)
    assert set(at) == set(range(len(x))) and np.bincount(at).max() <= neighbours.REPLICAS and len(lists) > len(x)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01"])
def test_measured_recall(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = t.orderBy("vec_id").collect()
    want = brute(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows]))
    assert recall(found(neighbours.search(t)), want) >= 0.9


def test_dimensions_keys_and_doubles(spark):
    """Every dimension is searched; a key's other vector is a candidate; doubles stay doubles; extra columns with the operator's names."""
    rows = [(0, [0.1, 0.2], "a", 1), (0, [0.3, 0.1], "b", 2), (3, [0.5, 0.6], None, 3), (20, [0.5, 0.25, 1e-9], None, 4), (5, [1.0, 2.0, 3.0], None, 5), (40, [7.0], None, 6), (3, [0.5, 0.6], "again", 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, h string, first int").withColumns({"v": F.lit(1), "list": F.lit(2), "d": F.lit("x")})
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.search(df).collect())
    pair = lambda a, b: float((np.array(a) * b).sum())
    first = [(0, 1, 3, pair(rows[0][1], rows[2][1])), (0, 2, 0, pair(rows[0][1], rows[1][1]))]
    second = [(0, 1, 3, pair(rows[1][1], rows[2][1])), (0, 2, 0, pair(rows[0][1], rows[1][1]))]
    assert got == sorted([*first, *second, (20, 1, 5, pair(rows[3][1], rows[4][1]))])


def test_few_of_many_vectors_are_compared(spark):
    """50000 vectors in clusters: recall by brute force, and the share of the table that a query is compared with."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 48))[rng.integers(300, size=50_000)] + 0.5 * rng.normal(size=(50_000, 48))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(50_000), "embedding": list(x)}), "vec_id long, embedding array<float>").repartition(8)
    ids = np.arange(50_000)
    with common.Scratch(spark) as scratch:
        _, postings, probes = neighbours.prepared(df, scratch)
        n = {r["list"]: r["count"] for r in postings.groupBy("list").count().collect()}
        read = sum(n[r["list"]] * r["count"] for r in probes.groupBy("list").count().collect())
    assert read < 0.1 * 50_000 * 2500
    got, x, hits = found(neighbours.search(df)), x.astype(np.float64), 0
    for q in ids[::20]:
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({v for v, _ in got[q]} & set(np.argpartition(-s, 20)[:20].tolist()))
    assert hits >= 0.9 * 20 * 2500
