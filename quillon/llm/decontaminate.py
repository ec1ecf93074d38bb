"""Benchmark decontamination by SimHash over item-sized windows.

Texts and items are words of digits, letters and non-ASCII characters, lower-cased; a shingle is five words (all of an item with fewer). For
an item of n words every window of n words that shares a shingle with an item of that size gets a 128-bit SimHash of its weighted shingles;
windows that share none have similarity 0 and are passed over without loss. Fingerprints are found through BLOCKS blocks of bits: two within
RADIUS differ in some block by RADIUS // BLOCKS bits or fewer, and each block's table lists items under all values that near. Of fingerprints
that have nothing in common 8 % become candidates, and of these next to none are within RADIUS. Candidates are verified by the exact similarity: the weight of shared shingles over that of all, counts included. A shingle weighs the more the fewer
items of the whole benchmark have it, in however many blocks the items are searched.

At similarity 0.8 two fingerprints differ in 19 bits on average, with a deviation of 4, so RADIUS leaves out about two windows in a thousand
at the threshold, and a copied item is at distance 0.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import ALNUM, find_words, kept_rows, looked_up, mix, rolled, text_bytes, text_parts

SHINGLE, SIMILARITY = 5, 0.8
BITS, BLOCKS, RADIUS = 128, 8, 31
#: Items that one pass over the texts looks for (about 35 kB of tables each); more take further passes.
ITEMS_AT_ONCE = 2048
#: Windows whose candidates are found at once.
WINDOWS = 1024
_WIDTH = BITS // BLOCKS
_FILTER_BITS = 22


def near_values(radius: int) -> np.ndarray:
    """Masks of a block with at most radius bits set."""
    return np.array([sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(_WIDTH), k)], np.uint16)


def bit_signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of BITS bits of each hash."""
    both = np.stack([hashes, mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))], 1)
    return np.unpackbits(both.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def pack(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, as BLOCKS numbers of 16 bits: a bit is set where the weighted sum of signs is above 0."""
    return np.packbits(sums > 1e-9, axis=-1).view(np.uint16)


class Blocks:
    """Fingerprints by block: each block's values within near bits of a fingerprint's, sorted, with the numbers of the fingerprints."""

    def __init__(self, prints: np.ndarray, radius: int) -> None:
        self.prints, self.radius = prints, radius
        near, owner = near_values(radius // BLOCKS), np.arange(len(prints), dtype=np.int32)
        self.tables = []
        for b in range(BLOCKS):
            values, owners = (prints[:, b, None] ^ near).ravel(), np.repeat(owner, len(near))
            order = np.argsort(values, kind="stable")
            self.tables.append((values[order], owners[order]))

    def candidates(self, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, fingerprint) of all pairs that are near in some block, part by part."""
        for at in range(0, len(windows), WINDOWS):
            part, pairs = windows[at : at + WINDOWS], []
            for b, (values, owners) in enumerate(self.tables):
                low, high = (np.searchsorted(values, part[:, b], side) for side in ("left", "right"))
                count = high - low
                place = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
                pairs.append(np.repeat(np.arange(len(part)), count) * len(self.prints) + owners[place])
            both = np.unique(np.concatenate(pairs))
            yield both // len(self.prints) + at, both % len(self.prints)

    def within(self, windows: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(window, fingerprint, distance) of all pairs within the radius."""
        for w, i in self.candidates(windows):
            distance = np.bitwise_count(windows[w] ^ self.prints[i]).sum(1, dtype=np.int64)
            near = distance <= self.radius
            yield from zip(w[near].tolist(), i[near].tolist(), distance[near].tolist(), strict=True)


@dataclass
class Match:
    item: int
    similarity: float
    distance: int
    first_word: int
    n_words: int


def item_shingles(column: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Numbers of words, and by item the shingles of those that have some."""
    words = find_words(*text_bytes(column), ALNUM)
    bounds = words.bounds()
    sizes = np.diff(bounds)
    shingles = {}
    for n in np.flatnonzero(sizes).tolist():
        part = words.hashes[bounds[n] : bounds[n + 1]]
        shingles[n] = rolled(part, np.zeros(len(part), np.int64), min(SHINGLE, int(sizes[n])))[0]
    return sizes, shingles


@dataclass
class Frequencies:
    """Of all items: how many have words, and the sorted shingles of two or more with the number of items that have each."""

    items: int
    keys: np.ndarray
    df: np.ndarray


def frequencies(sets: list[np.ndarray]) -> Frequencies:
    keys, df = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
    return Frequencies(len(sets), keys[df > 1], df[df > 1])


class Items:
    """An index over items (id, text). Weights are by the frequencies of all items, by default of these."""

    def __init__(self, items: list[tuple[int, str | None]], similarity: float = SIMILARITY, radius: int = RADIUS, among: Frequencies | None = None) -> None:
        self.similarity, self.radius = similarity, radius
        sizes, self.shingles = item_shingles(pa.array([t for _, t in items], pa.string()))
        self.ids = [i for i, _ in items]
        #: By shingle size (5, or that of shorter items).
        by_k: dict[int, list[int]] = defaultdict(list)
        for n in self.shingles:
            by_k[min(SHINGLE, int(sizes[n]))].append(n)
        self.sizes = sizes
        sets = [np.unique(s) for s in self.shingles.values()]
        self.keys = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        among = among or frequencies(sets)
        #: A shingle of one item weighs as much as one of none.
        self.top = float(np.log1p(among.items))
        self.repeated, self.weights = among.keys, np.log1p(among.items / among.df)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.keys >> np.uint64(64 - _FILTER_BITS)] = True
        self.groups: dict[tuple[int, int], dict] = {}
        for k, numbers in by_k.items():
            for size in sorted({int(sizes[n]) for n in numbers}):
                own = [n for n in numbers if sizes[n] == size]
                prints = np.stack([self.fingerprint(self.shingles[n]) for n in own])
                self.groups[k, size] = {"items": own, "blocks": Blocks(prints, radius), "keys": np.unique(np.concatenate([self.shingles[n] for n in own]))}

    def weigh(self, shingles: np.ndarray) -> np.ndarray:
        return looked_up(shingles, self.repeated, self.weights, self.top)

    def fingerprint(self, shingles: np.ndarray) -> np.ndarray:
        return pack(self.weigh(shingles) @ bit_signs(mix(shingles)))

    def alike(self, window: np.ndarray, item: np.ndarray) -> float:
        """Weighted Jaccard similarity of two bags of shingles."""
        (a, n), (b, m) = np.unique(window, return_counts=True), np.unique(item, return_counts=True)
        both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        shared = (self.weigh(both) * np.minimum(n[i], m[j])).sum()
        return float(shared / ((self.weigh(a) * n).sum() + (self.weigh(b) * m).sum() - shared)) if len(a) and len(b) else 0.0

    def search(self, hashes: np.ndarray, hits: dict[int, tuple[np.ndarray, np.ndarray]]) -> list[Match]:
        """Best window for each item in a text's words; hits: by shingle size the places and hashes of shingles that items have."""
        best: dict[int, Match] = {}
        for (k, size), group in self.groups.items():
            if k not in hits:
                continue
            at, found = hits[k]
            own = at[np.isin(found, group["keys"])]
            if not len(own):
                continue
            span = min(size, len(hashes))
            last = len(hashes) - span
            starts = np.unique(np.clip((own[:, None] - np.arange(span - k + 1)).ravel(), 0, last))
            a, b = int(starts[0]), int(starts[-1]) + span
            shingles, _ = rolled(hashes[a:b], np.zeros(b - a, np.int64), k)
            for part in np.split(starts, np.flatnonzero(np.diff(starts) > span) + 1):  # windows that lie together share their sums
                i, j = int(part[0]) - a, int(part[-1]) - a + span - k + 1
                sums = np.concatenate([np.zeros((1, BITS)), np.cumsum(self.weigh(shingles[i:j])[:, None] * bit_signs(mix(shingles[i:j])), axis=0)])
                lo = part - a - i
                prints = pack(sums[lo + span - k + 1] - sums[lo])
                for w, n, distance in group["blocks"].within(prints):
                    start, item = int(part[w]), group["items"][n]
                    similarity = self.alike(shingles[start - a : start - a + span - k + 1], self.shingles[item])
                    known = best.get(item)
                    if similarity >= self.similarity and (known is None or (similarity, -distance, -start) > (known.similarity, -known.distance, -known.first_word)):
                        best[item] = Match(self.ids[item], similarity, distance, start, span)
        return [best[i] for i in sorted(best)]

    def matches(self, column: pa.Array) -> Iterator[tuple[int, list[Match]]]:
        """(row, its matches) of the rows that have some."""
        for a, b in text_parts(column):
            words = find_words(*text_bytes(column.slice(a, b - a)), ALNUM)
            bounds, hits = words.bounds(), defaultdict(dict)
            for k in {k for k, _ in self.groups}:
                shingles, at = rolled(words.hashes, words.doc, k)
                likely = np.flatnonzero(self.filter[shingles >> np.uint64(64 - _FILTER_BITS)])
                likely = likely[np.isin(shingles[likely], self.keys)]
                doc = words.doc[at[likely]]
                for d in np.unique(doc).tolist():
                    own = likely[doc == d]
                    hits[d][k] = (at[own] - bounds[d], shingles[own])
            for d in sorted(hits):
                if found := self.search(words.hashes[bounds[d] : bounds[d + 1]], hits[d]):
                    yield a + d, found


def all_frequencies(texts: DataFrame) -> Frequencies:
    """Frequencies over a column of item texts; shingles of one item don't come to the driver."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(s).view(np.int64) for s in item_shingles(batch.column(0))[1].values()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]))], names=["key"])

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(item_shingles(batch.column(0))[1])], pa.int64())], names=["n"])

    items = texts.mapInArrow(some, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    found = texts.mapInArrow(each, "key bigint").groupBy("key").agg(F.count("*").alias("df")).where("df > 1").toArrow()
    keys, df = found["key"].to_numpy().view(np.uint64), found["df"].to_numpy()
    order = np.argsort(keys)
    return Frequencies(items, keys[order], df[order])


def item_blocks(benchmark: DataFrame, item_id: str, text: str, at_once: int) -> Iterator[tuple[list[tuple[int, str | None]], Frequencies | None]]:
    """The items in blocks of at_once rows, each brought to the driver in turn; repeated rows once. With the frequencies of all, if blocks are several."""
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(text).cast("string").alias("t")).dropDuplicates()
    total = rows.count()
    if total <= at_once:
        yield [(r.i, r.t) for r in rows.orderBy("i", "t").collect()], None
        return
    among = all_frequencies(rows.select("t"))
    blocks = -(-total // at_once)
    part = F.pmod(F.xxhash64("i", "t"), F.lit(2 * blocks))  # twice as many, so that an uneven block stays small
    for b in range(2 * blocks):
        yield [(r.i, r.t) for r in rows.where(part == b).orderBy("i", "t").collect()], among


MATCHES = "doc_id {kind}, item_id {item}, similarity double, distance int, first_word bigint, n_words bigint"


def find_matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """(doc_id, item_id, similarity, distance, first_word, n_words): a row for each text and item with a window at least that similar.

    The best window counts, ties to the first. Texts and items that are NULL or without words match nothing; a text shorter than an item is
    one window. Repeated rows match each. Rows stay in their partitions and texts of any length are read whole.
    """
    kinds, spark = dict(docs.dtypes), docs.sparkSession
    schema = MATCHES.format(kind=kinds["doc_id"], item=dict(benchmark.dtypes)["item_id"])
    kind = T._parse_datatype_string(schema)

    def finder(shared) -> Callable:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(batch.column(0)[r].as_py(), m.item, m.similarity, m.distance, m.first_word, m.n_words) for r, own in shared.value.matches(batch.column(1)) for m in own]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        return found

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    parts = [texts.mapInArrow(finder(spark.sparkContext.broadcast(Items(block, similarity, radius, among))), schema) for block, among in item_blocks(benchmark, "item_id", "text", at_once)]
    return reduce(DataFrame.unionByName, parts)


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """The rows of docs, all columns, in which no window is that similar to an item; nothing is shuffled.

    Texts that are NULL, empty or without words stay, long ones are read whole, and repeated rows stay or go alike.
    """

    def dropper(shared, place: int) -> Callable:
        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, _ in shared.value.matches(batch.column(place))]] = False
                yield from kept_rows(batch, keep, place)

        return kept

    for block, among in item_blocks(benchmark, "item_id", "text", at_once):
        shared = docs.sparkSession.sparkContext.broadcast(Items(block, similarity, radius, among))
        docs = docs.mapInArrow(dropper(shared, docs.columns.index("text")), docs.schema)
    return docs
