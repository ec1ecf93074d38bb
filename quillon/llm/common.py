"""What the operators share: free column names, cut lineage, and words of Arrow text columns as numpy arrays.

Text is handled as UTF-8 bytes in blocks of bounded size. A word's 64-bit hash is a polynomial over its bytes modulo 2^64, mixed; equal
words have equal hashes in every process, and different words collide with a chance of about 2^-60 a pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quillon.session import pinned, shared_folder

#: Bytes of text handled at once by a worker.
BLOCK = 1 << 19
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores before it while the frame has such a column (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Scratch:
    """Parquet tables in the shared folder that end the lineage of a job's steps, and are gone when the block ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.tables = spark, f"{shared_folder(spark)}/tables-{uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        df.write.parquet(path := f"{self.root}/{self.tables}")
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: int) -> None:
        """Removes the tables with these numbers, or all."""
        for path in [f"{self.root}/{n}" for n in names] or [self.root]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def byte_class(include: Iterable[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(include)] = True
    return out


#: A-Z to a-z; other bytes stay.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Bytes of words: all but space, tab, line and page breaks; or digits, a-z and all that isn't ASCII.
NOT_SPACE = ~byte_class([0x20, *range(0x09, 0x0E)])
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, up to n; kept up to the size of a block."""
    if len(_powers["p"]) < n:
        size = max(n, BLOCK + 1)
        with np.errstate(over="ignore"):
            table = {k: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for k, b in (("p", _BASE), ("i", _U(pow(int(_BASE), -1, 1 << 64))))}
        if size > 4 * BLOCK:
            return table["p"], table["i"]
        _powers.update(table)
    return _powers["p"], _powers["i"]


@dataclass
class Words:
    """Words of several texts in order: hash, text number, and the places of their bytes."""

    hashes: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    texts: int

    def bounds(self) -> np.ndarray:
        """Text i has the words bounds[i] to bounds[i + 1]."""
        return np.searchsorted(self.doc, np.arange(self.texts + 1))


def text_parts(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most size bytes of text in each, or one row."""
    lengths = np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    ends, i = np.cumsum(lengths), 0
    while i < len(lengths):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield i, j
        i = j


def kept_rows(batch: pa.RecordBatch, keep: np.ndarray, place: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch where keep holds, in batches of at most BLOCK bytes of text in column place, or one row: what the JVM gets back at once."""
    for a, b in text_parts(batch.column(place), BLOCK):
        if keep[a:b].any():
            yield batch.slice(a, b - a).filter(pa.array(keep[a:b]))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts and their n + 1 offsets; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE) -> Words:
    """Words of lower-cased texts; long input goes piece by piece, cut between words."""
    inside = kind[LOWER[data]]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    edges = offsets[(offsets < len(data))]
    if len(data):
        before[edges] = False
        before[0] = False
        after[edges[edges > 0] - 1] = False
        after[-1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    del inside, before, after
    hashes, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, side="right")))
        a, b = start[i], end[j - 1]
        p, inverse = _power(int(b - a) + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[LOWER[data[a:b]]] * p[: b - a], out=sums[1:])
        s, e = start[i:j] - a, end[i:j] - a
        hashes[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        i = j
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(hashes, doc, start, end, len(offsets) - 1)


def word_hash(words: list[str], kind: np.ndarray = NOT_SPACE) -> np.ndarray:
    """Hashes of single words, as find_words has them."""
    found = find_words(*text_bytes(pa.array(words, pa.string())), kind)
    if len(found.doc) != len(words) or (found.doc != np.arange(len(words))).any():
        raise ValueError("each text has to be one word")
    return found.hashes


def rolled(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one text, and the place of the first word of each."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(count, np.uint64)
    for k in range(n):
        total = (total + hashes[k : k + count]) * _BASE
    at = np.flatnonzero(doc[:count] == doc[n - 1 :])
    return mix(total[at]), at


def looked_up(hashes: np.ndarray, keys: np.ndarray, values: np.ndarray, missing: int = -1) -> np.ndarray:
    """values of sorted keys for each hash."""
    if not len(keys):
        return np.full(len(hashes), missing, values.dtype)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, values[at], missing)
