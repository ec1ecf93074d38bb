import random

from quillon.llm import decontaminate as dc


def test_blocks_of_items_change_nothing(spark):
    """Items with shared boilerplate and copies with one to four words changed: similarities on both sides of 0.8."""
    rng = random.Random(4)
    words = lambda n: ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]
    shared = [words(20) for _ in range(3)]
    items = [(i, " ".join(shared[i % 3] + words(20))) for i in range(24)]
    docs = []
    for i, text in items:
        for edits in range(1, 5):
            own = text.split()
            for at in rng.sample(range(40), edits):
                own[at] = "changed"
            docs.append((10 * i + edits, " ".join(own)))
    docs, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    results = []
    for at_once in (100, 8):
        found = dc.find_matches(docs, benchmark, at_once=at_once)
        kept = dc.clean(docs, benchmark, at_once=at_once)
        results.append((sorted(map(tuple, found.collect())), sorted(r.doc_id for r in kept.collect())))
    (whole, kept), (blocks, kept_blocks) = results
    assert 0 < len(whole) and 0 < len(kept) and min(m[2] for m in whole) < 0.85
    assert [m[:2] + m[3:] for m in whole] == [m[:2] + m[3:] for m in blocks] and kept == kept_blocks
    assert all(abs(a[2] - b[2]) < 1e-12 for a, b in zip(whole, blocks, strict=True))
