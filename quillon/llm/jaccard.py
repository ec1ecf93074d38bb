"""Joining documents by the Jaccard similarity of their five-word shingles: a T-occurrence search over inverted lists.

Documents with equal shingle sets are one class. A class of n shingles shares at least ceil(0.8 n) of them with any partner, so at most
n // 5 of its shingles, in the order of their hashes, stand before the first shared one; the prefix of n // 5 + T(n) shingles therefore has
T occurrences, the smaller T of the two counting, of shingles that both prefixes have. Everything follows from that bound, without loss:

1. Prefix shingles of all classes become inverted lists. Lists of one class are gone at once.
2. A class that is left with fewer shingles than the T it must share has no partner. The others skip as many of their longest lists as T
   allows, less one: at least one shared list remains, the shortest that the two share.
3. Classes joined by remaining lists form families. In families of more than LOOSE classes or above a block the same is done once more with the lists of whole sets, where
   T is the overlap itself: what only shares passages that many have falls apart.
4. Families are searched one by one, large ones block by block: each class's rarest lists are merged by a heap, and each candidate is probed
   in the skipped long lists by binary search (DivideSkip). The occurrences of all lists are the overlap, which decides exactly. Pairs
   already joined through others aren't tried again.
5. Labels of classes joined by links give components.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import NOT_SPACE, Scratch, find_words, fresh, mix, pinned, rolled, text_bytes, text_parts
from quillon.llm.graph import components

SHINGLE = 5
#: List lengths above this count as equal when classes choose the lists to skip.
LONG = 4096
#: Classes and shingles of a block of a family at most.
BLOCK, BLOCK_SHINGLES = 1500, 2_000_000
#: Entries, of those that may be partners, up to which lists are merged by a heap of Python; above, by one sort.
HEAP = 4096
#: Candidates at once whose overlaps all_partners counts.
MARKED = 4096
#: Classes of a family above which its lists are taken from whole sets.
LOOSE = 4
#: T of small classes: all of the overlap up to this number.
SURE = 16
#: Rows of a table at most that texts are joined with by a broadcast (56 bytes each); above, by shuffling.
BROADCAST_CLASSES = 1_000_000
#: Classes that a task remembers so as not to repeat copies.
REMEMBERED = 500_000
_U = np.uint64


def overlap_at_least(n: np.ndarray) -> np.ndarray:
    """What a class of n shingles shares with any partner."""
    return (4 * n + 4) // 5


def occurrences(n: np.ndarray) -> np.ndarray:
    """T of a class of n shingles."""
    return np.maximum((n + 9) // 10, np.minimum(overlap_at_least(n), SURE))


def shared_at_least(n: np.ndarray) -> np.ndarray:
    """The smallest T of a class of n shingles and any partner, which has at least ceil(0.8 n)."""
    return occurrences(overlap_at_least(n))


def linked(overlap: int, a: int, b: int) -> bool:
    return 100 * overlap >= 80 * (a + b - overlap)


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, shingles, bounds) of parts of a text column: row i's set, sorted, is shingles[bounds[i] : bounds[i + 1]]."""
    for a, b in text_parts(column):
        words = find_words(*text_bytes(column.slice(a, b - a)), NOT_SPACE)
        found, at = rolled(words.hashes, words.doc, SHINGLE)
        doc = words.doc[at]
        counts = np.bincount(words.doc, minlength=b - a)
        short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
        if len(short):
            starts = words.bounds()
            more = []
            for d in short.tolist():
                own = words.hashes[starts[d] : starts[d + 1]]
                more.append(mix(rolled(own, np.zeros(len(own), np.int64), len(own))[0] + _U(len(own))))
            found, doc = np.concatenate([found, *more]), np.concatenate([doc, short])
        order = np.lexsort((found, doc))
        found, doc = found[order], doc[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
        found, doc = found[new], doc[new]
        yield a, b, found, np.searchsorted(doc, np.arange(b - a + 1))


def class_ids(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; 0 for empty ones."""
    sizes, out = np.diff(bounds), np.zeros(len(bounds) - 1, _U)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = mix(np.add.reduceat(mix(shingles + _U(0x51ED270B)), bounds[full]) + sizes[full].astype(_U)) | _U(1)
    return out


class _Once:
    """Which classes come for the first time, as far back as memory allows."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def first(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), bool)
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        for i, x in enumerate(ids.tolist()):
            if x and x not in self.seen:
                self.seen.add(x)
                out[i] = True
        return out


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, ids = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
        for _, _, shingles, bounds in shingle_sets(batch.column(1)):
            n.append(np.diff(bounds))
            ids.append(class_ids(shingles, bounds))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(n)), pa.array(np.concatenate(ids).view(np.int64))], names=["doc_id", "hash", "n", "class"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    once = _Once()
    for batch in batches:
        for _, _, shingles, bounds in shingle_sets(batch.column(0)):
            ids, n = class_ids(shingles, bounds), np.diff(bounds)
            length = np.where(once.first(ids), np.minimum(n, n // 5 + occurrences(n)), 0)
            at = np.repeat(bounds[:-1] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            yield pa.RecordBatch.from_arrays([pa.array(shingles[at].view(np.int64)), pa.array(np.repeat(ids, length).view(np.int64)), pa.array(np.repeat(n, length).astype(np.int32))], names=["token", "class", "n"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(family, blocks, loose, class, n, shingles) of rows (family, blocks, loose, class, n, text); a class once in a task."""
    once = _Once()
    for batch in batches:
        class_ = batch.column(3).to_numpy()
        for a, b, shingles, bounds in shingle_sets(batch.column(5)):
            keep = np.flatnonzero(once.first(class_[a:b]))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(shingles.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(keep + a)) for c in range(5)), lists.take(pa.array(keep))], names=["family", "blocks", "loose", "class", "n", "shingles"])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings sorted by token and class: those of lists of two classes or more, with the list's length up to LONG.

    A list is held until LONG of its rows are there; a longer one then passes through.
    """
    names = ["token", "class", "n"]
    held = {c: np.zeros(0, np.int64) for c in names}
    passing: int | None = None  # token of a long list under way

    def out(rows: dict[str, np.ndarray], df: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows["token"]), pa.array(rows["class"]), pa.array(rows["n"].astype(np.int32)), pa.array(df.astype(np.int32))], names=[*names, "df"])

    def done(rows: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        starts = np.flatnonzero(np.append(True, rows["token"][1:] != rows["token"][:-1])) if len(rows["token"]) else np.zeros(0, np.int64)
        df = np.repeat(np.diff(np.append(starts, len(rows["token"]))), np.diff(np.append(starts, len(rows["token"]))))
        live = df > 1
        return out({c: v[live] for c, v in rows.items()}, np.minimum(df[live], LONG)) if live.any() else None

    for batch in batches:
        rows = {c: np.concatenate([held[c], batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, c in enumerate(names)}
        if not len(rows["token"]):
            continue
        same = np.append(False, (rows["token"][1:] == rows["token"][:-1]) & (rows["class"][1:] == rows["class"][:-1]))
        rows = {c: v[~same] for c, v in rows.items()}
        if passing is not None:
            more = int(np.searchsorted(rows["token"] != passing, True)) if (rows["token"] != passing).any() else len(rows["token"])
            if more > 1:  # the first row is the last one of before, kept to find copies
                yield out({c: v[1:more] for c, v in rows.items()}, np.full(more - 1, LONG))
            if more == len(rows["token"]):
                held = {c: v[-1:] for c, v in rows.items()}
                continue
            rows, passing = {c: v[more:] for c, v in rows.items()}, None
        last = int(np.flatnonzero(np.append(True, rows["token"][1:] != rows["token"][:-1]))[-1])
        if (found := done({c: v[:last] for c, v in rows.items()})) is not None:
            yield found
        held = {c: v[last:] for c, v in rows.items()}
        if len(held["token"]) >= LONG:
            yield out(held, np.full(len(held["token"]), LONG))
            passing = int(held["token"][0])
            held = {c: v[-1:] for c, v in held.items()}
    if passing is None and (found := done(held)) is not None:
        yield found


def _kept(need: Callable[[np.ndarray], np.ndarray]) -> Callable:
    """Postings sorted by class, length of list and token: of classes with as many as they need, all but the longest that can be skipped."""

    def chosen(token: np.ndarray, class_: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.append(True, class_[1:] != class_[:-1])) if len(class_) else np.zeros(0, np.int64)
        count = np.diff(np.append(starts, len(class_)))
        rank = np.arange(len(class_)) - np.repeat(starts, count)
        keep = rank < np.repeat(count - need(n[starts]) + 1, count)
        return pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(class_[keep])], names=["token", "class"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64) for _ in range(3)]
        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, h in enumerate(held)]
            if not len(held[0]):
                continue
            last = int(np.flatnonzero(np.append(True, held[1][1:] != held[1][:-1]))[-1])  # a class has no more rows than its set
            if last:
                yield chosen(*(h[:last] for h in held))
                held = [h[last:] for h in held]
        yield chosen(*held)

    return kept


def merged(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different entries of sorted lists, and in how many each stands."""
    total = sum(map(len, lists))
    if total > HEAP:
        return np.unique(np.concatenate(lists), return_counts=True)
    entries: list[int] = []
    counts: list[int] = []
    heap = [(int(x[0]), i, 0) for i, x in enumerate(lists) if len(x)]
    heapq.heapify(heap)
    while heap:
        value, i, at = heap[0]
        if entries and entries[-1] == value:
            counts[-1] += 1
        else:
            entries.append(value)
            counts.append(1)
        if at + 1 < len(lists[i]):
            heapq.heapreplace(heap, (int(lists[i][at + 1]), i, at + 1))
        else:
            heapq.heappop(heap)
    return np.array(entries, np.int64), np.array(counts, np.int64)


def linked_pairs(sets: list[np.ndarray], group: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links (i, j) that join what is linked, which changes group.

    A query needs T = ceil(0.8 n) occurrences in its n lists, so T - 1 of the longest are skipped and the others merged; every entry is a
    candidate, and its occurrences in the long lists are found by binary search in its set.
    """
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    known, number = np.unique(token, return_inverse=True)
    by = np.lexsort((owner, number))
    starts = np.searchsorted(number[by], np.arange(len(known) + 1))
    entries, df = owner[by], np.diff(starts)
    bounds = np.cumsum(size) - size
    ids = [number[b : b + n] for b, n in zip(bounds, size, strict=True)]
    rank = np.empty(len(sets), np.int64)
    rank[order] = np.arange(len(sets))
    for q in order.tolist():
        mine, n = ids[q], int(size[q])
        needed = (4 * n + 4) // 5
        by_length = mine[np.argsort(df[mine], kind="stable")]
        short, long = by_length[: n - needed + 1], by_length[n - needed + 1 :]
        lists = [entries[starts[t] : starts[t + 1]] for t in short.tolist() if df[t] > 1]
        if not lists:
            continue
        # Partners that come before the query, aren't too small, and aren't joined with it: each pair is met once.
        flat = np.concatenate(lists)
        ok = (rank[flat] < rank[q]) & (size[flat] * 5 >= 4 * n) & (group[flat] != group[q])
        if not ok.any():
            continue
        ends = np.cumsum(ok)[np.cumsum([len(x) for x in lists]) - 1]
        found, counts = merged(np.split(flat[ok], ends[:-1]))
        long = np.sort(long)
        for j in np.argsort(-counts, kind="stable").tolist():
            p, theirs = int(found[j]), ids[found[j]]
            if group[p] == group[q]:
                continue
            at = np.searchsorted(theirs, long)
            overlap = int(counts[j]) + int((theirs[np.minimum(at, len(theirs) - 1)] == long).sum())
            if linked(overlap, n, int(size[p])):
                group[group == group[p]] = group[q]
                yield p, q


def all_partners(sets: list[np.ndarray], side: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(j, all i linked with j that come before it by size): each link once, or with side only links between different sides.

    Candidates are the entries of the lists that linked_pairs merges. Their overlaps are counted together, by marking the query's shingles
    and summing the marks of each candidate's set, so that a pair costs as many steps as its set has shingles, and no Python object.
    """
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size, starts = size[order], np.append(0, np.cumsum(size[order]))
    side = None if side is None else side[order]
    known, number = np.unique(np.concatenate([sets[k] for k in order.tolist()]), return_inverse=True)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), size)
    entries = owner[np.argsort(number, kind="stable")]  # each list by size of its sets
    df = np.bincount(number, minlength=len(known))
    lists = np.append(0, np.cumsum(df))
    marks, candidate = np.zeros(len(known), np.uint8), np.zeros(len(sets), bool)
    for q in range(1, len(sets)):
        mine, n = number[starts[q] : starts[q + 1]], int(size[q])
        short = mine[np.argsort(df[mine], kind="stable")[: n - (4 * n + 4) // 5 + 1]]
        candidate[:q] = False
        for t in short.tolist():
            if df[t] > 1:
                candidate[entries[lists[t] : lists[t + 1]]] = True
        found = np.flatnonzero(candidate[:q])
        found = found[size[found] * 5 >= 4 * n]
        if side is not None:
            found = found[side[found] != side[q]]
        if not len(found):
            continue
        marks[mine] = 1
        overlap = np.concatenate([_marked(marks, number, starts, size, found[k : k + MARKED]) for k in range(0, len(found), MARKED)])
        marks[mine] = 0
        found = found[100 * overlap >= 80 * (n + size[found] - overlap)]
        if len(found):
            yield int(order[q]), order[found]


def _marked(marks: np.ndarray, number: np.ndarray, starts: np.ndarray, size: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """How many of each set's shingles are marked; sets ascend."""
    count, (a, b) = size[sets], (int(sets[0]), int(sets[-1]) + 1)
    if starts[b] - starts[a] <= 3 * count.sum():  # a stretch is summed faster than its parts are put together
        return np.add.reduceat(marks[number[starts[a] : starts[b]]], starts[a:b] - starts[a], dtype=np.int64)[sets - a]
    first = np.cumsum(count) - count
    return np.add.reduceat(marks[number[np.repeat(starts[sets] - first, count) + np.arange(count.sum())]], first, dtype=np.int64)


def divide_skip(sets: list[np.ndarray], group: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links (i, j) that join what is linked, and each set's group in the end. What is in one group from the start counts as joined."""
    group = np.arange(len(sets)) if group is None else np.unique(group, return_inverse=True)[1]
    return list(linked_pairs(sets, group)), group


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], np.ndarray, Iterator[tuple[int, np.ndarray]]]]:
    """Of rows (family, i, j, own, class, copies, shingles) sorted by task (family, i, j): each task's classes, their copies, and all links
    between blocks i and j, or in block i = j, as all_partners gives them."""
    task, members = None, {}

    def found() -> tuple[list[int], np.ndarray, Iterator[tuple[int, np.ndarray]]]:
        own, copies, sets = zip(*members.values(), strict=True)
        return list(members), np.array(copies, np.int64), all_partners(list(sets), None if task[1] == task[2] else np.array(own))

    for batch in batches:
        keys, lists = list(zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True)), batch.column(6)
        for row, (family, i, j, own, class_, copies) in enumerate(keys):
            if (family, i, j) != task:
                if len(members) > 1:
                    yield found()
                task, members = (family, i, j), {}
            if class_ not in members:  # copies of a class from several tasks count once
                members[class_] = own, copies, lists[row].values.to_numpy().view(np.uint64).copy()
    if len(members) > 1:
        yield found()


def _all_linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links (a, b) of each task."""
    for classes, _, partners in _met(batches):
        ids = np.array(classes, np.int64)
        for q, p in partners:
            yield pa.RecordBatch.from_arrays([pa.array(ids[p]), pa.array(np.full(len(p), ids[q]))], names=["a", "b"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, others): the rows of the classes that a task's links lead to. A task gives as many rows as it has linked classes."""
    for classes, copies, partners in _met(batches):
        others = np.zeros(len(classes), np.int64)
        for q, p in partners:
            others[q] += copies[p].sum()
            others[p] += copies[q]
        some = others > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.array(classes, np.int64)[some]), pa.array(others[some])], names=["class", "others"])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (family, i, j, class, known, shingles) sorted by task (family, i, j): (family, class, known, label) of each task's classes.

    label is the smallest known group that the task's links join a class with.
    """
    task, members, known, sets = None, [], [], []

    def labels() -> pa.RecordBatch:
        first = {c: k for k, c in reversed(list(enumerate(members)))}  # copies of a class from several tasks count once
        at = sorted(first.values())
        own = np.array([known[k] for k in at], np.int64)
        group = divide_skip([sets[k] for k in at], own)[1] if len(at) > 1 else np.zeros(1, np.int64)
        smallest = np.full(group.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, group, own)
        return pa.RecordBatch.from_arrays([pa.array([task[0]] * len(at), pa.int64()), pa.array([members[k] for k in at], pa.int64()), pa.array(own), pa.array(smallest[group])], names=["family", "class", "known", "label"])

    for batch in batches:
        keys, lists = list(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)), batch.column(5)
        for row, (family, i, j, class_, group) in enumerate(keys):
            if (family, i, j) != task:
                if task is not None:
                    yield labels()
                task, members, known, sets = (family, i, j), [], [], []
            members.append(class_)
            known.append(group)
            sets.append(lists[row].values.to_numpy().view(np.uint64).copy())
    if task is not None:
        yield labels()


def _by(df: DataFrame, *keys: str, order: tuple[str, ...] = ()) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def _joined(postings: DataFrame, need: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(class, family) of the classes of postings (token, class, n) that may have partners; partners are in one family."""
    listed = _by(postings, "token", order=("class",)).mapInArrow(_lists, "token bigint, class bigint, n int, df int")
    with Scratch(postings.sparkSession) as scratch:
        kept = scratch.put(_by(listed, "class", order=("df", "token")).select("token", "class", "n").mapInArrow(_kept(need), "token bigint, class bigint"))
        # Each class of a list with the list's smallest: minima combine before they are moved, and a join of a hot list can be split.
        heads = kept.groupBy("token").agg(F.min("class").alias("a"))
        stars = kept.join(heads, "token").where("a <> class").select("a", F.col("class").alias("b")).distinct()
        return components(stars).select(F.col("node").alias("class"), F.col("label").alias("family"))


def families_of(docs: DataFrame) -> DataFrame:
    """(class, family) from prefix lists."""
    text = docs.select(F.col("text").cast("string").alias("text"))
    return _joined(text.mapInArrow(_postings, "token bigint, class bigint, n int"), shared_at_least)


def members_of(docs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(family, blocks, class, n, shingles) of the classes in families; rows: as _rows has them.

    Families and blocks are settled on narrow tables, so that only texts of members are read again, one of each class, and a set moves by
    its class. Members of loose families go by the lists of their whole sets into families anew.
    """
    texts = rows.where("class <> 0").groupBy("class").agg(F.first("n").alias("n"), F.min(F.struct("doc_id", "hash")).alias("t"))
    chosen = scratch.put(_with_blocks(families_of(docs).join(texts, "class")).select("family", "blocks", "loose", "class", "n", F.col("t.doc_id").alias("id"), F.col("t.hash").alias("hash")))
    few = chosen.count() <= BROADCAST_CLASSES
    text = docs.select(F.col("doc_id").alias("row_id"), F.col("text").cast("string").alias("text")).withColumn("row_hash", F.xxhash64("text"))
    own = text.join(F.broadcast(chosen) if few else chosen, (F.col("row_hash") == F.col("hash")) & F.col("row_id").eqNullSafe(F.col("id")))
    members = scratch.put(own.select("family", "blocks", "loose", "class", "n", "text").mapInArrow(_sets, "family bigint, blocks int, loose boolean, class bigint, n bigint, shingles array<bigint>"))
    large = members.where("loose")
    if large.isEmpty():
        return members.drop("loose")
    lists = large.select("family", "class", F.col("n").cast("int").alias("n"), F.explode("shingles").alias("s")).select(F.xxhash64("family", "s").alias("token"), "class", "n")
    anew = scratch.put(_with_blocks(_joined(lists, overlap_at_least).join(large.groupBy("class").agg(F.first("n").alias("n")), "class")))
    moved = large.select("class", "shingles").join(anew, "class").select("family", "blocks", "class", "n", "shingles")
    return members.where("NOT loose").drop("loose").unionByName(scratch.put(moved))


def _blocks(rows: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(rows / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _with_blocks(narrow: DataFrame) -> DataFrame:
    """Adds to each class (class, family, n) the number of its family's blocks, and whether the family is loose."""
    blocks = _blocks(F.count("*"), F.sum("n"))
    return narrow.join(narrow.groupBy("family").agg(blocks.alias("blocks"), ((F.count("*") > LOOSE) | (blocks > 1)).alias("loose")), "family")


def _search(tasks: DataFrame) -> DataFrame:
    ordered = _by(tasks.select("family", "i", "j", "class", "known", "shingles"), "family", "i", "j")
    return ordered.mapInArrow(_searched, "family bigint, class bigint, known bigint, label bigint")


def label_members(members: DataFrame, scratch: Scratch) -> DataFrame:
    """(class, label) of members (family, blocks, class, n, shingles): classes that links join have one label.

    A family of one block is one task. In a larger one, blocks are searched by themselves first, then one member of each component found,
    in the same way, which joins a large group of near copies in two readings of its sets. Only what is still apart is then compared:
    members outside a family's largest component meet all its blocks and each other, so that nothing is left out. Who meets whom is settled
    on narrow tables, and sets move by their class and by their task alone.
    """
    known = members.withColumn("known", F.col("class"))
    single = _search(known.where("blocks = 1").withColumns({"i": F.lit(0), "j": F.lit(0)})).select("class", "label")
    large = known.where("blocks > 1")
    if large.isEmpty():
        return single
    deal = lambda n: F.pmod(F.xxhash64("class"), n).cast("int")
    groups = scratch.put(_search(large.withColumn("i", deal(F.col("blocks"))).withColumn("j", F.col("i"))).select("family", "class", "label"))
    heads = groups.where("class = label").select("class", "family")
    if heads.count() < 0.7 * groups.count():
        sized = _with_blocks(heads.join(large.groupBy("class").agg(F.first("n").alias("n")), "class"))
        above = label_members(scratch.put(large.select("class", "shingles").join(sized, "class").select("family", "blocks", "class", "n", "shingles")), scratch)
        above = above.select(F.col("class").alias("label"), F.col("label").alias("up"))
        groups = scratch.put(groups.join(above, "label", "left").select("family", "class", F.coalesce("up", "label").alias("label")))
    counted = groups.groupBy("family", "label").agg(F.count("*").alias("k"))
    apart = counted.groupBy("family").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    narrow = groups.join(apart, "family").join(large.groupBy("class").agg(F.first("n").alias("n")), "class")
    narrow = scratch.put(narrow.select("family", "class", F.col("label").alias("known"), (F.col("label") != F.col("main")).alias("rest"), "n"))
    if narrow.isEmpty():
        return single.unionByName(groups.select("class", "label"))
    in_rest = lambda x: F.when(F.col("rest"), x).otherwise(F.lit(0))
    in_main = lambda x: F.when(F.col("rest"), F.lit(0)).otherwise(x)
    one = F.lit(1)
    cut = narrow.groupBy("family").agg(_blocks(F.sum(in_rest(one)), F.sum(in_rest(F.col("n")))).alias("rest_blocks"), _blocks(F.sum(in_main(one)), F.sum(in_main(F.col("n")))).alias("main_blocks"))
    dealt = large.select("class", "shingles").join(narrow.join(cut, "family"), "class")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    main = dealt.where(~F.col("rest")).withColumn("j", -1 - deal(F.col("main_blocks"))).withColumn("i", each(F.col("rest_blocks")))
    rest = dealt.where("rest").withColumn("own", deal(F.col("rest_blocks")))
    to_main = rest.withColumn("i", F.col("own")).withColumn("m", each(F.col("main_blocks"))).withColumn("j", -1 - F.col("m"))
    to_rest = rest.withColumn("other", each(F.col("rest_blocks"))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    columns = ["family", "i", "j", "class", "known", "shingles"]
    tasks = main.select(*columns).unionByName(to_main.select(*columns)).unionByName(to_rest.select(*columns))
    edges = _search(tasks).where("known <> label").select(F.col("known").alias("a"), F.col("label").alias("b")).distinct()
    joined = components(edges).select(F.col("node").alias("label"), F.col("label").alias("up"))
    return single.unionByName(groups.join(joined, "label", "left").select("class", F.coalesce("up", "label").alias("label")))


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, n, class) of each row: a hash of its text, the size of its set, and its class, 0 without shingles."""
    kind = dict(docs.dtypes)["doc_id"]
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return text.withColumn("hash", F.xxhash64("text")).mapInArrow(_classes, f"doc_id {kind}, hash bigint, n bigint, class bigint")


def _labelled(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(class, id, label): each class that isn't empty, its smallest doc_id, and its component's label."""
    with Scratch(docs.sparkSession) as scratch:
        found = label_members(members_of(docs, rows, scratch), scratch)
        smallest = rows.where("class <> 0").groupBy("class").agg(F.min("doc_id").alias("id"))
        return pinned(smallest.join(found, "class", "left").withColumn("label", F.coalesce("label", "class")))


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, class) for each row.

    component_id is the smallest doc_id that links lead to, the row's own included; NULL doc_ids are none, so it is NULL only where a
    component has no other. Texts that are NULL or without words have no shingles, no class and no links; long ones are read whole, and
    other columns not at all. Repeated rows are copies like any.
    """
    rows = pinned(_rows(docs))
    smallest = _labelled(rows, docs)
    by_label = smallest.groupBy("label").agg(F.min("id").alias("component"))
    by_class = smallest.select("class", "label").join(by_label, "label").select("class", "component")
    out = rows.join(by_class, "class", "left")
    own = F.when(F.col("class") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.when(F.col("class") != 0, F.col("class")).alias("class"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, of which one of each component stays: that of the smallest doc_id, then of the smallest class and text hash.

    Rows without shingles are linked with nothing and all stay. NULL doc_ids come last. Of rows alike in doc_id and text the smallest stays,
    by the other columns in their order (NULL first; columns that have no order don't count). Texts are moved only to tell such rows apart.
    """
    rows = pinned(_rows(docs)).where("class <> 0")
    labels = _labelled(rows, docs).select("class", "label")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("class"), F.col("hash"))
    ranked = rows.groupBy("doc_id", "hash", "class").agg(F.count("*").alias("copies")).join(labels, "class").withColumn("rank", rank)
    first = ranked.groupBy("label").agg(F.min("rank").alias("first"))
    judged = ranked.join(first, "label").select("doc_id", "hash", (F.col("rank") == F.col("first")).alias("stays"), "copies")
    # Most rows stay and aren't in this table: only what goes, or stays as one of several.
    judged = pinned(judged.where("NOT stays OR copies > 1").select(F.col("doc_id").alias("__id"), F.col("hash").alias("__of"), "stays"))
    hashed, id_, of, stays = (fresh(docs, name) for name in ("__hash", "__id", "__of", "__stays"))
    judged = judged.select(F.col("__id").alias(id_), F.col("__of").alias(of), F.col("stays").alias(stays))
    few = judged.count() <= BROADCAST_CLASSES
    told = docs.withColumn(hashed, F.xxhash64(F.col("text").cast("string")))
    told = told.join(F.broadcast(judged) if few else judged, (F.col(hashed) == F.col(of)) & F.col("doc_id").eqNullSafe(F.col(id_)), "left")
    alone = told.where(F.col(stays).isNull()).select(*_columns(docs))
    if judged.where(stays).isEmpty():
        return alone
    ordered = [f"`{f.name}`" for f in docs.schema.fields if _has_order(f.dataType)]
    least = told.where(stays).groupBy("doc_id", hashed).agg(F.min_by(F.struct(*_columns(docs)), F.struct(*ordered)).alias("row"))
    return alone.unionByName(least.select("row.*"))


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _has_order(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_order(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_has_order(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def _meetings(members: DataFrame) -> DataFrame:
    """Members (family, blocks, class, n, copies, shingles) dealt to tasks (family, i, j): each block of a family meets each other."""
    dealt = members.withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return _by(met.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "copies", "shingles"), "family", "i", "j")


def links(docs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(a, b): every pair of different classes whose similarity is 0.8 or more, once, in any order."""
    with Scratch(docs.sparkSession) as scratch:
        members = members_of(docs, _rows(docs) if rows is None else rows, scratch).withColumn("copies", F.lit(1).cast("bigint"))
        return pinned(_meetings(members).mapInArrow(_all_linked, "a bigint, b bigint"))


def count_links(docs: DataFrame) -> DataFrame:
    """(doc_id, n_links) for each row: how many other rows it is linked with, copies included.

    Links are counted where they are found: pairs grow with the square of a group, what is moved and kept does not.
    """
    rows = pinned(_rows(docs))
    copies = pinned(rows.where("class <> 0").groupBy("class").agg(F.count("*").alias("copies")))
    with Scratch(docs.sparkSession) as scratch:
        counted = _meetings(members_of(docs, rows, scratch).join(copies, "class")).mapInArrow(_counted, "class bigint, others bigint")
        others = pinned(counted.groupBy("class").agg(F.sum("others").alias("others")))
    counted = copies.join(others, "class", "left").select("class", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return rows.join(counted, "class", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


#: The same for DuckDB: all pairs that share a shingle, and what they lead to.
SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, UNNEST(sh) AS h FROM s),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * COUNT(*) >= 80 * (a.n + b.n - COUNT(*))),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS id, doc_id AS led FROM s UNION SELECT id, b FROM reach JOIN both_ways ON led = a)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id FROM s JOIN (SELECT id, MIN(led) AS component_id FROM reach GROUP BY id) ON id = doc_id"""

#: The number of links by doc_id for DuckDB.
LINKS_SQL = SQL[: SQL.index("reach AS")].rstrip().rstrip(",") + " SELECT s.doc_id, COUNT(b) AS n_links FROM s LEFT JOIN both_ways ON s.doc_id = a GROUP BY s.doc_id"
