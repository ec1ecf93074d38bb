from collections import Counter

import pytest

from quillon.llm import sharding


def test_slots_are_even():
    counts = Counter(sharding.lookup_table(16, 2039))
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1


def test_each_shard_takes_its_first_free_slot_in_turn():
    names, size = [0, 1, 2], 11
    table, taken = sharding.lookup_table(names, size), set()
    for turn in range(size):
        offset, skip = sharding.preference(names[turn % 3], size, sharding.SEED)
        slot = next(s for j in range(size) if (s := (offset + j * skip) % size) not in taken)
        assert table[slot] == names[turn % 3]
        taken.add(slot)


def test_most_slots_stay_when_a_shard_goes():
    before, after = sharding.lookup_table(16, 2039), sharding.lookup_table([s for s in range(16) if s != 5], 2039)
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != 5)
    assert moved < 0.25 * 2039 and 5 not in after


@pytest.mark.parametrize("shards, size", [(0, 7), (8, 7), (3, 8)])
def test_bad_sizes(shards, size):
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, size)


def test_odd_rows(odd, none, tmp_path):
    out = sharding.place(odd)
    assert out.count() == odd.count() and sharding.place(none).count() == 0
    assert out.columns == [c for c in odd.columns if c != "shard"] + ["slot", "shard"]
    assert out.where("doc_id = 1").select("shard").distinct().count() == 1
    assert out.where("slot IS NULL OR shard IS NULL").count() == 0
    sharding.write_shards(out, f"{tmp_path}/out")
    assert odd.sparkSession.read.parquet(f"{tmp_path}/out").count() == odd.count()


def test_no_shuffle(odd):
    plan = sharding.place(odd)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
