"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: (offset + j * skip) mod size, both from a hash of its name. The
shards take turns, each claiming the first slot in its order that is still free, until the table is full: slots are even to within one, and
when a shard comes or goes most slots keep their shard. A row's key hash picks a slot, the table its shard.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import fresh

SHARDS, SIZE, SEED = 16, 2039, 1
#: The table is broadcast, so its size has a bound.
MOST_SLOTS = 1 << 20


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preference(shard: int, size: int, seed: int) -> tuple[int, int]:
    """Offset and skip of a shard's order."""
    digest = md5(f"{seed}|shard|{shard}".encode()).hexdigest()
    return int(digest[:8], 16) % size, int(digest[8:16], 16) % (size - 1) + 1


def lookup_table(shards: int | list[int] = SHARDS, size: int = SIZE, seed: int = SEED) -> list[int]:
    """The shard of each slot. shards: a number, or the names of those in service."""
    names = list(range(shards)) if isinstance(shards, int) else list(shards)
    if not names or not is_prime(size) or not len(names) <= size <= MOST_SLOTS:
        raise ValueError(f"needs shards, and a prime size of at least their number and at most {MOST_SLOTS}")
    orders = [preference(s, size, seed) for s in names]
    at, table, left = [0] * len(names), [-1] * size, size
    while left:
        for i, (offset, skip) in enumerate(orders):
            while table[slot := (offset + at[i] * skip) % size] >= 0:
                at[i] += 1
            table[slot] = names[i]
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, size: int = SIZE, seed: int = SEED) -> Column:
    """The slot of a key; NULL counts as the empty string."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % size


def place(docs: DataFrame, key: str = "doc_id", shards: int | list[int] = SHARDS, size: int = SIZE, seed: int = SEED, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """All rows and columns, with slot (long) and shard (int).

    Rows stay in their partitions: the table is a broadcast of at most MOST_SLOTS rows, and placement one probe of it. Equal keys go to one
    shard, NULL keys to that of the empty string. Columns of the input named as slot or shard are replaced. Texts aren't read.
    """
    table = lookup_table(shards, size, seed)
    at, taken, owner = (fresh(docs, name) for name in ("__at", "__slot", "__shard"))
    lookup = docs.sparkSession.createDataFrame(list(enumerate(table)), f"`{taken}` bigint, `{owner}` int")
    placed = docs.withColumn(at, slot_of(F.col(f"`{key}`"), size, seed)).join(F.broadcast(lookup), F.col(at) == F.col(taken))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (slot.lower(), shard.lower())]
    return placed.select(*kept, F.col(taken).alias(slot), F.col(owner).alias(shard))


def write_shards(placed: DataFrame, path: str, key: str = "doc_id", shard: str = "shard", tasks_per_shard: int = 4) -> None:
    """Writes a folder for each shard; each shard's rows come from several tasks, dealt by key."""
    salt = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(tasks_per_shard))
    placed.repartition(F.col(shard), salt).write.mode("overwrite").partitionBy(shard).parquet(path)


#: The same for DuckDB: claims, turn by turn, over a bit string of taken slots.
SQL = f"""WITH RECURSIVE pref AS (
  SELECT s, CAST('0x' || substr(md5('{SEED}|shard|' || s), 1, 8) AS BIGINT) % {SIZE} AS off,
         CAST('0x' || substr(md5('{SEED}|shard|' || s), 9, 8) AS BIGINT) % {SIZE - 1} + 1 AS skip FROM range({SHARDS}) t(s)),
claim AS (
  SELECT 0 AS turn, CAST(-1 AS BIGINT) AS slot, CAST(repeat('0', {SIZE}) AS BIT) AS taken
  UNION ALL
  SELECT turn + 1, slot_, set_bit(taken, CAST(slot_ AS INTEGER), 1) FROM (
    SELECT turn, taken, list_filter(list_transform(range({SIZE}), lambda j: (off + j * skip) % {SIZE}), lambda x: get_bit(taken, CAST(x AS INTEGER)) = 0)[1] AS slot_
    FROM claim JOIN pref ON s = turn % {SHARDS} WHERE turn < {SIZE})),
tab AS (SELECT slot, CAST((turn - 1) % {SHARDS} AS INTEGER) AS shard FROM claim WHERE turn > 0)
SELECT doc_id, text, lang, source, n_chars, slot, shard FROM (SELECT *, CAST('0x' || substr(md5('{SEED}|' || COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SIZE} AS slot FROM documents)
JOIN tab USING (slot)"""
