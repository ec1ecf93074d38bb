import pyarrow as pa
import pytest

from quillon.llm import decontaminate, language
from quillon.llm.common import BLOCK

WORDS = "the cat and the dog of the house with that "


class Taken:
    """A frame that gives back what mapInArrow is called with."""

    def __init__(self, df):
        self.df = df

    def __getattr__(self, name):
        return getattr(self.df, name)

    def mapInArrow(self, function, schema):
        return function


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.mark.parametrize("stage", ["language", "decontamination"])
def test_whole_rows_come_back_in_blocks(spark, docs, stage):
    passage = " ".join(f"passage{i}" for i in range(30))
    texts = [WORDS * 4000, None, "", *[WORDS * (1000 + i) for i in range(40)], WORDS * 20_000, "123", f"{WORDS}{passage}"]
    batch = pa.RecordBatch.from_pydict({c: texts if c == "text" else [str(i) for i in range(len(texts))] for c in docs.columns})
    if stage == "language":
        kept, goes = language.keep_known(Taken(docs), language.fit(docs)), {1, 2, len(texts) - 2}
    else:
        kept, goes = decontaminate.clean(Taken(docs), spark.createDataFrame([(1, passage)], "item_id long, text string")), {len(texts) - 1}
    found = list(kept(iter([batch])))
    assert len(found) > 1 and all(b.num_rows == 1 or sum(len(t or "") for t in b.column("text").to_pylist()) <= BLOCK for b in found)
    assert pa.Table.from_batches(found).equals(pa.Table.from_batches([batch.take(pa.array([i for i in range(len(texts)) if i not in goes]))]))
