import re
from collections import Counter

import corpus_pipeline
import pytest
from test_jaccard import brute
from test_mixing import draw

from quillon.llm import mixing, sharding
from quillon.llm.common import documents


@pytest.fixture(scope="module")
def kept(spark, sf, tmp_path_factory):
    """Each stage's rows, written and read again."""
    out, docs = [("documents", documents(spark, sf))], documents(spark, sf)
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return out


def test_columns(kept):
    for _, docs in kept[:-1]:
        assert docs.columns == kept[0][1].columns
    assert kept[-1][1].columns == [*kept[0][1].columns, "slot", "shard"]


def test_language_keeps_texts_with_letters(kept):
    assert kept[1][1].count() == kept[0][1].where("text RLIKE '[A-Za-z]'").count()


def test_one_of_each_group(kept):
    rows = [(r.doc_id, r.text) for r in kept[1][1].collect()]
    assert sorted(r.doc_id for r in kept[2][1].collect()) == sorted({c for _, _, c in brute(rows)})


def test_no_benchmark_passage_stays(spark, sf, kept):
    plain = lambda t: " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower()))
    items = [f" {plain(r.text)} " for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    has = lambda r: any(i in f" {plain(r.text)} " for i in items)
    assert sorted(r.doc_id for r in kept[3][1].collect()) == sorted(r.doc_id for r in kept[2][1].collect() if not has(r))


def test_copies(kept):
    rows = kept[3][1].collect()
    n = Counter(r.source for r in rows)
    total = sum(x**mixing.ALPHA for x in n.values())
    rate = {s: len(rows) * x**mixing.ALPHA / total / x for s, x in n.items()}
    want = {r.doc_id: c for r in rows if (c := draw(r.doc_id, rate[r.source]))}
    assert Counter(r.doc_id for r in kept[4][1].collect()) == want


def test_shards(kept):
    table = sharding.lookup_table()
    assert all(table[r.slot] == r.shard for r in kept[5][1].collect()) and kept[5][1].count() == kept[4][1].count()


def test_run_is_all_stages(spark, sf, kept):
    key = lambda df: sorted(map(str, df.collect()))
    assert key(corpus_pipeline.run(spark, sf)) == key(kept[-1][1])


def test_odd_documents(spark, sf, odd, none):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for df in (docs, none.select(*docs.columns)):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, sf)
        df.collect()
