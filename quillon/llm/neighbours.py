"""Nearest neighbours by inner product over balanced posting lists.

A vector x gets one more component, sqrt(M^2 - |x|^2) with M the largest norm, and a query a zero: then the largest inner product is the
smallest distance. Centroids are fitted by k-means that evens out list sizes, on a bounded sample; every vector is then put into the list of
its nearest centroid and, if it lies near a boundary, into up to REPLICAS - 1 more. A query walks a graph of centroids in memory, best first,
and visits the lists whose centroid is no farther than a ratio times the nearest one's distance, up to a number of lists. Both are measured on
the index: of those with which the lists visited have the share TARGET of the true neighbours of TRIALS queries, found among all vectors, the
pair that visits fewest. Where vectors lie in clusters few lists suffice, where they don't many. There are about 2 sqrt(n) lists, so that lists and what a query reads of the graph
grow with the root of the table. Long lists are cut into chunks and a list's queries into parts, so that no task grows with a list.

Vectors of different dimensions have no inner product, so each dimension is searched by itself; one of at most WHOLE vectors is one list.
Equal vectors are one entry with the k + 1 smallest of their ids. Nothing is lost by that: among equal scores the smaller ids win, a result
has k rows, and one more makes up for the query's own row.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, pinned

K, EVERY = 20, 20
#: Vectors of a dimension that are compared without lists; lists at most; sample vectors a list, at least, and numbers in the sample at most.
WHOLE, MOST_LISTS, PER_LIST, SAMPLE, SAMPLE_NUMBERS = 4096, 16_384, 8, 20_000, 8_000_000
REPLICAS, REPLICA_RATIO = 3, 1.15
DEGREE, ENTRIES, BEAM = 24, 32, 8
#: Recall that the ratio is chosen for, and queries at most that it is measured with.
TARGET, TRIALS = 0.94, 100
#: Most vectors of a chunk and queries of a part.
CHUNK, PART = 4096, 4096


def usable(vector: Column) -> Column:
    """Not NULL, without NULL or non-finite components, and not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((x**2).sum(1)[:, None] + (centroids**2).sum(1) - 2 * (x @ centroids.T), 0)


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 9) -> np.ndarray:
    """k-means in which a list above its share is made to look farther away, the more the larger it is."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centroids, extra = x[rng.choice(len(x), k, replace=False)].copy(), np.zeros(k)
    for _ in range(rounds):
        near = np.empty(len(x), np.int64)
        spread = 0.0
        for i in range(0, len(x), 4096):
            d = distances(x[i : i + 4096], centroids)
            spread += d.min(1).sum()
            near[i : i + 4096] = (d + extra).argmin(1)
        sizes = np.bincount(near, minlength=k)
        extra = np.maximum(0, extra + 0.1 * spread / len(x) * (sizes * k / len(x) - 1))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        full = sizes > 0
        centroids[full] = sums[full] / sizes[full, None]
        if (~full).any():
            centroids[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centroids


class CentroidGraph:
    """Each centroid linked with near ones in different directions, and with its neighbour in a ring, so that all can be reached."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE, entries: int = ENTRIES) -> None:
        self.centroids = centroids
        self.links: list[np.ndarray] = []
        n = len(centroids)
        for i in range(n):
            d = distances(centroids[i : i + 1], centroids)[0]
            d[i] = np.inf
            order = np.argsort(d, kind="stable")[: 4 * degree]
            order = order[np.isfinite(d[order])]
            chosen: list[int] = []
            for j in order:
                if len(chosen) < degree // 2 and all(((centroids[j] - centroids[c]) ** 2).sum() >= d[j] for c in chosen):
                    chosen.append(int(j))
            chosen += [int(j) for j in order if int(j) not in chosen][: degree - len(chosen)]
            self.links.append(np.unique(np.array([*chosen, (i + 1) % n], np.int64)))
        # Entries far from each other, so that a walk begins in every region.
        self.entries = [0]
        d = ((centroids - centroids[0]) ** 2).sum(1)
        while len(self.entries) < min(entries, n):
            self.entries.append(int(d.argmax()))
            d = np.minimum(d, ((centroids - centroids[self.entries[-1]]) ** 2).sum(1))

    def search(self, q: np.ndarray, ratio: float, count: int | None = None, sizes: np.ndarray | None = None, need: int = 0) -> np.ndarray:
        """The nearest count centroids within ratio times the nearest one's distance, and as many more as have lists of need entries in all.

        Nearest first. The walk goes on while among the last BEAM there were any within the ratio, or half as many more as count.
        """
        count = len(self.centroids) if count is None else count
        todo = list(zip(((self.centroids[self.entries] - q) ** 2).sum(1).tolist(), self.entries, strict=True))
        heapq.heapify(todo)
        seen, found, nearest, beyond, have = set(self.entries), [], np.inf, 0, 0
        while todo and (beyond < BEAM and len(found) < count + count // 2 + BEAM or have < need):
            d, at = heapq.heappop(todo)
            have += sizes[at] if need else 0
            nearest = min(nearest, d)
            beyond = beyond + 1 if d > nearest * ratio**2 and len(found) >= BEAM else 0
            found.append((d, at))
            new = [j for j in self.links[at].tolist() if j not in seen]
            seen.update(new)
            for j, dj in zip(new, ((self.centroids[new] - q) ** 2).sum(1).tolist() if new else [], strict=True):
                heapq.heappush(todo, (dj, j))
        found.sort()
        before = np.cumsum([0, *(sizes[j] for _, j in found[:-1])]) if need else np.full(len(found), need)
        return np.array([j for i, (d, j) in enumerate(found) if not i or before[i] < need or i < count and d <= nearest * ratio**2], np.int64)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(most - (x**2).sum(1), 0))[:, None]], 1)


def lists_of(x: np.ndarray, centroids: np.ndarray, replicas: int = REPLICAS, ratio: float = REPLICA_RATIO) -> tuple[np.ndarray, np.ndarray]:
    """(vector, list): each vector's nearest centroid, and up to replicas - 1 more within ratio times that one's distance."""
    width, vectors, lists = min(len(centroids), replicas), [], []
    for i in range(0, len(x), 4096):
        d = distances(x[i : i + 4096], centroids)
        near = np.argpartition(d, width - 1, axis=1)[:, :width]
        far = np.take_along_axis(d, near, 1)
        r, c = np.nonzero(far <= far.min(1, keepdims=True) * ratio**2)
        vectors.append(r + i)
        lists.append(near[r, c])
    return (np.concatenate(vectors), np.concatenate(lists)) if vectors else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def nearest_in(queries: np.ndarray, vectors: np.ndarray, first_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the k best vectors and their scores, ties to the smaller id. Each score is summed in one fixed order."""
    for i in range(0, len(queries), 256):
        part = queries[i : i + 256]
        rough = part @ vectors.T
        for r, row in enumerate(rough):
            if len(row) > k:
                kth = np.partition(row, len(row) - k)[len(row) - k]
                slack = 1e-9 * (abs(kth) + np.abs(part[r]).sum() * np.abs(vectors).max())
                at = np.flatnonzero(row >= kth - slack)
            else:
                at = np.arange(len(row))
            exact = (part[r] * vectors[at]).sum(1)
            order = np.lexsort((first_ids[at], -exact))[:k]
            yield i + r, at[order], exact[order]


def true_lists(classes: DataFrame, index, asked: list[tuple[int, np.ndarray]], k: int) -> list[list[list[int]]]:
    """For each of the queries (hash, vector) the lists of each of its k nearest among all other vectors; all vectors are compared."""
    entry = pa.list_(pa.struct([("s", pa.float64()), ("id", pa.int64()), ("lists", pa.list_(pa.int32()))]))
    shared = classes.sparkSession.sparkContext.broadcast((np.array([i for i, _ in asked]), np.stack([q for _, q in asked])))  # at most TRIALS vectors

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (own, queries), (graph, most) = shared.value, index.value
        best: list[list[tuple[float, int, np.ndarray]]] = [[] for _ in own]
        for batch in batches:
            if not batch.num_rows:
                continue
            x, first = _matrix(batch.column(0)), batch.column(1).to_numpy()
            scores = x @ queries.T
            scores[first[:, None] == own] = -np.inf
            top = np.argpartition(-scores, min(k, len(x)) - 1, axis=0)[:k]
            for i in range(len(own)):
                rows = [(-float(scores[r, i]), int(first[r]), x[r]) for r in top[:, i].tolist() if np.isfinite(scores[r, i])]
                best[i] = sorted(best[i] + rows, key=lambda e: e[:2])[:k]
        for i, rows in enumerate(best):
            if rows:
                at, lists = lists_of(augmented(np.stack([x for _, _, x in rows]), most), graph.centroids)
                found = [{"s": s, "id": id_, "lists": lists[at == n].tolist()} for n, (s, id_, _) in enumerate(rows)]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([found], entry)], names=["q", "best"])

    found = classes.select("v", "h").mapInArrow(compared, "q int, best array<struct<s:double,id:bigint,lists:array<int>>>")
    merged = found.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    rows = {r.q: [list(b.lists) for b in r.best] for r in merged.collect()}
    return [rows.get(i, []) for i in range(len(asked))]


def cut_needed(graph: CentroidGraph, queries: list[np.ndarray], wanted: list[list[list[int]]], target: float = TARGET) -> tuple[float, int]:
    """The ratio and the number of lists that visit fewest lists of those that reach the share target of the wanted entries.

    wanted: for each query, each entry's lists.
    """
    ratios, ranks, within = [], [], []
    for q, own in zip(queries, wanted, strict=True):
        d = np.sqrt(distances(np.append(q, 0.0)[None], graph.centroids)[0])
        d /= max(d.min(), 1e-12)
        rank = np.argsort(np.argsort(d, kind="stable"), kind="stable")
        best = [min(lists, key=d.__getitem__) for lists in own]
        ratios += [d[j] for j in best]
        ranks += [rank[j] for j in best]
        within.append(np.sort(d))
    if not ratios:
        return 1.0, 1
    ratios, ranks, needed = np.array(ratios), np.array(ranks), max(1, int(np.ceil(target * len(ratios))))
    options = []
    for ratio in np.unique(np.sort(ratios)[np.linspace(needed - 1, len(ratios) - 1, 16).astype(int)]) * (1 + 1e-9):
        count = int(np.sort(ranks[ratios <= ratio])[needed - 1]) + 1
        options.append((float(np.mean([min(count, np.searchsorted(d, ratio, side="right")) for d in within])), float(ratio), count))
    _, ratio, count = min(options)
    while True:  # a walk may miss a centroid
        visited = [set(graph.search(np.append(q, 0.0), ratio, count).tolist()) for q in queries]
        if sum(not seen.isdisjoint(lists) for seen, own in zip(visited, wanted, strict=True) for lists in own) >= needed or all(len(v) == len(graph.centroids) for v in visited):
            return ratio, count
        ratio, count = ratio * 1.02, count + (count + 19) // 20


def _dealt(classes: DataFrame, queries: DataFrame, scratch: Scratch, dimension: int, n: int, most: float, k: int, target: float) -> tuple[DataFrame, DataFrame]:
    """Postings (d, list, v, ids, first, h) and probes (d, list, v, h) of the n vectors and the queries of one dimension."""
    spark = classes.sparkSession
    lists = max(1, min(MOST_LISTS, int(np.ceil(2 * np.sqrt(n)))))
    size = min(max(SAMPLE, PER_LIST * lists), max(1, SAMPLE_NUMBERS // dimension))
    sample = classes.select("v").orderBy(F.xxhash64("h"), "v").limit(size).toArrow()
    graph = CentroidGraph(balanced_centroids(augmented(_matrix(sample["v"]), most), lists))
    index = spark.sparkContext.broadcast((graph, most))  # at most MOST_LISTS centroids
    trials = queries.orderBy(F.xxhash64("h", F.lit(1)), "v").limit(TRIALS).toArrow()
    ratio, count = 1.0, 1
    if trials.num_rows:
        tried = list(_matrix(trials["v"]))
        ratio, count = cut_needed(graph, tried, true_lists(classes, index, list(zip(trials["h"].to_pylist(), tried, strict=True)), k), target)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, most = index.value
        for batch in batches:
            if not batch.num_rows:
                continue
            at, lists = lists_of(augmented(_matrix(batch.column(0)), most), graph.centroids)
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), *(batch.column(c).take(at) for c in range(4))], names=["list", "v", "ids", "first", "h"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (graph, _), counts = index.value, sizes.value
        for batch in batches:
            out = [graph.search(np.append(q, 0.0), ratio, count, counts, REPLICAS * (k + 1)) for q in _matrix(batch.column(0))]
            at = pa.array(np.repeat(np.arange(len(out)), [len(x) for x in out]), pa.int64())
            lists = np.concatenate(out) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at)], names=["list", "v", "h"])

    kind = dict(classes.dtypes)["v"]
    d = F.lit(dimension).alias("d")
    postings = scratch.put(classes.select("v", "ids", "first", "h").mapInArrow(put, f"list int, v {kind}, ids array<bigint>, first bigint, h bigint")).select(d, "*")
    counted = np.zeros(len(graph.centroids), np.int64)
    for r in postings.groupBy("list").agg(F.count("*").alias("n")).collect():  # at most MOST_LISTS
        counted[r.list] = r.n
    sizes = spark.sparkContext.broadcast(counted)
    return postings, queries.select("v", "h").mapInArrow(probe, f"list int, v {kind}, h bigint").select(d, "*")


def prepared(vectors: DataFrame, scratch: Scratch, k: int = K, every: int = EVERY, vector: str = "embedding", key: str = "vec_id", target: float = TARGET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries (id, h), and postings and probes by d and list; h is a hash of the vector."""
    kind = dict(vectors.dtypes)[vector]
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast(kind).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).distinct()
    #: One row for each different vector, with its smallest ids; the limit by rank takes effect before the shuffle too.
    by_vector = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= k + 1)
    classes = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = scratch.put(classes.select("v", "ids", F.col("ids")[0].alias("first"), F.xxhash64("v").alias("h"), F.size("v").alias("d")))
    asked = rows.where(F.col("id") % every == 0).select("id", "v", F.xxhash64("v").alias("h"), F.size("v").alias("d"))
    queries = scratch.put(asked.select("v", "h", "d").distinct())
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sizes = classes.groupBy("d").agg(F.count("*").alias("n"), F.max(norm).alias("m")).where(F.col("n") > WHOLE).collect()  # large dimensions
    large = [r.d for r in sizes]
    whole = lambda df: df.where(~F.col("d").isin(large)) if large else df
    none = F.lit(0).alias("list")
    postings, probes = whole(classes).select("d", none, "v", "ids", "first", "h"), whole(queries).select("d", none, "v", "h")
    for r in sizes:
        of = F.col("d") == r.d
        more, asks = _dealt(classes.where(of), queries.where(of), scratch, r.d, r.n, r.m, k, target)
        postings, probes = postings.unionByName(more), probes.unionByName(asks)
    return asked.select("id", "h"), postings, scratch.put(probes)


def search(vectors: DataFrame, k: int = K, every: int = EVERY, vector: str = "embedding", key: str = "vec_id", target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose key is divisible by every, among all other rows.

    Rows without key and vectors that aren't usable take no part; an input without any gives no rows. Vectors are compared with those of
    their dimension. Rows with the same key and vector count once; of a key with several vectors each is a query and a candidate by itself,
    and a query's own row is the one with its key and its vector. Scores are sums of products of doubles, ties go to the smaller key. Other
    columns aren't read.
    """
    with Scratch(vectors.sparkSession) as scratch:
        asked, postings, probes = prepared(vectors, scratch, k, every, vector, key, target)
        # Rows of each list, at most MOST_LISTS numbers a large dimension and one for each other.
        at = ["d", "list"]
        long = postings.groupBy(*at).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
        many = probes.groupBy(*at).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        cut = scratch.put(long.join(many, at))
        deal = lambda of, n: F.pmod(F.xxhash64(of), n).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        left = probes.join(cut, at).withColumn("part", deal("h", F.col("parts"))).withColumn("chunk", each(F.col("chunks"))).select(*at, "chunk", "part", "h", "v")
        right = postings.join(cut, at).withColumn("chunk", deal("h", F.col("chunks"))).withColumn("part", each(F.col("parts"))).select(*at, "chunk", "part", "first", "ids", "h", "v")
        keys = [*at, "chunk", "part"]
        schema = "q bigint, best array<struct<s:double,id:bigint,h:bigint>>"
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_nearest(k), schema).mapInArrow(_combined(k), schema)
        # Entries that replicas bring twice are equal, score included, and lie side by side when sorted.
        merged = found.groupBy("q").agg(F.array_sort(F.flatten(F.collect_list("best"))).alias("all"))
        different = F.filter("all", lambda b, i: ~b.eqNullSafe(F.get("all", i - 1)))
        merged = merged.select("q", F.slice(different, 1, k + 1).alias("best"))
        kept = F.slice(F.filter("best", lambda b: (b["id"] != F.col("id")) | (b["h"] != F.col("h"))), 1, k)
        out = asked.join(merged, F.col("h") == F.col("q")).select(F.col("id").alias("query_id"), F.posexplode(kept).alias("r", "b"))
        return pinned(out.select("query_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.s")).alias("score")))


#: A query's best entries: the score with its sign turned, the key, and the vector's hash.
ENTRY = pa.list_(pa.struct([("s", pa.float64()), ("id", pa.int64()), ("h", pa.int64())]))
#: Entries that a task holds at most before it gives some of them away.
HELD = 2_000_000


def _entries(s: np.ndarray, ids: np.ndarray, hashes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    values = pa.StructArray.from_arrays([pa.array(s), pa.array(ids), pa.array(hashes)], fields=list(ENTRY.value_type))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values).cast(ENTRY)


def _combined(k: int) -> Callable:
    """Rows (q, best) to one row a query and task, or a few in a large task: its k + 1 best different entries."""

    def best(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        q, s, ids, hashes = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((hashes, ids, s, q))
        q, s, ids, hashes = q[order], s[order], ids[order], hashes[order]
        new = np.append(True, (q[1:] != q[:-1]) | (s[1:] != s[:-1]) | (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1]))[: len(q)]
        q, s, ids, hashes = q[new], s[new], ids[new], hashes[new]
        starts = np.flatnonzero(np.append(True, q[1:] != q[:-1])[: len(q)])
        keep = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q)))) <= k
        return q[keep], s[keep], ids[keep], hashes[keep]

    def batch(q: np.ndarray, s: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.append(True, q[1:] != q[:-1])[: len(q)])
        return pa.RecordBatch.from_arrays([pa.array(q[starts]), _entries(s, ids, hashes, np.append(starts, len(q)))], names=["q", "best"])

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for rows in batches:
            lists = rows.column(1)
            flat = lists.flatten()
            s, ids, hashes = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            held.append((np.repeat(rows.column(0).to_numpy(), np.diff(lists.offsets.to_numpy())), s, ids, hashes))
            count += len(s)
            if count > HELD:
                held = [best(held)]
                count = len(held[0][0])
                if 2 * count > HELD:
                    yield batch(*held[0])
                    held, count = [], 0
        if held:
            yield batch(*best(held))

    return combined


def _nearest(k: int) -> Callable:
    schema = pa.schema([("q", pa.int64()), ("best", ENTRY)])

    def nearest(asked: pa.Table, listed: pa.Table) -> pa.Table:
        """For each query of a part the k + 1 best entries of a chunk, with the score's sign turned."""
        if not asked.num_rows or not listed.num_rows:
            return schema.empty_table()
        q, first, hashes, ids = asked["h"].to_numpy(), listed["first"].to_numpy(), listed["h"].to_numpy(), listed["ids"].combine_chunks()
        starts, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
        who, best, offsets = [], [], [0]
        for i, at, exact in nearest_in(_matrix(asked["v"]), _matrix(listed["v"]), first, k + 1):
            count = starts[at + 1] - starts[at]
            own = np.concatenate([flat[a:b] for a, b in zip(starts[at], starts[at + 1], strict=True)])
            score, of = np.repeat(exact, count), np.repeat(hashes[at], count)
            order = np.lexsort((own, -score))[: k + 1]
            who.append(q[i])
            best.append((-score[order], own[order], of[order]))
            offsets.append(offsets[-1] + len(order))
        return pa.table([pa.array(who, pa.int64()), _entries(*(np.concatenate([b[e] for b in best]) for e in range(3)), offsets)], schema=schema)

    return nearest
