import numpy as np

from quillon.llm import neighbours


def test_lists_visited_grow_with_what_recall_takes(spark):
    """Vectors without clusters in many lists: a fixed number of lists leaves out most neighbours."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got: dict[int, set] = {}
    for r in neighbours.search(rows).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    x = x.astype(np.float64)
    found = 0
    for q in range(0, 6000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        found += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert found >= 0.92 * 300 * 20


def test_cut_needed():
    graph = neighbours.CentroidGraph(np.arange(1.0, 51.0)[:, None] * [1.0, 0.0])
    query = np.array([0.0])
    for wanted, lists in (([[0], [5, 40]], 6), ([[0], [3]], 4), ([[49]], 50)):
        ratio, count = neighbours.cut_needed(graph, [query], [wanted], 1.0)
        assert set(graph.search(np.append(query, 0.0), ratio, count).tolist()) == set(range(lists))
    assert neighbours.cut_needed(graph, [query], [[]], 1.0) == (1.0, 1)
    ratio, count = neighbours.cut_needed(graph, [query], [[[0], [1], [2], [9]]], 0.75)
    assert len(graph.search(np.append(query, 0.0), ratio, count)) == 3
