import pytest
from oracle import compare

from quillon.llm.queries import REGISTRY


@pytest.mark.parametrize("name", sorted(REGISTRY.oracles))
def test_query_equals_its_oracle(spark, sf, name):
    assert compare(REGISTRY.queries[name](spark, sf), REGISTRY.oracles[name], sf) > 0


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in REGISTRY.queries) == list(range(1, 11))
