"""Language identification by a linear-chain conditional random field over words.

Each word has features: its bytes' two- and three-grams, its first and last bytes, and its entry in a lexicon of words seen in training. A
label's score for a word is the sum of its features' weights, transitions between neighbouring words' labels are learned too, and
forward-backward gives each word's distribution over the languages. A text's language is the one with the largest mass over its words.

Training maximises the likelihood of sequences joined from stretches of texts of different languages, as code-switched text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Words, find_words, kept_rows, looked_up, text_bytes, text_parts
from quillon.llm.features import LETTERS, TABLE_BITS, affix_keys, gram_rows, held_out, labelled_sample, row, word_sums

UNKNOWN = "und"
#: Score below which keep_known drops a text: with four languages, hardly above chance.
LEAST_SCORE = 0.3
#: Bounds of training: texts (as many of each language), words from the middle of each, bytes of these, occurrences of a lexicon word at
#: least, rounds.
TEXTS, WORDS, MOST_BYTES, LEAST, ROUNDS = 1200, 240, 16_000, 3, 14
#: Words of a stretch of one language in a training sequence, and stretches.
STRETCH, STRETCHES = 24, 4
#: Words that forward-backward takes as one chunk.
CHUNK = 64


@dataclass
class Features:
    """Table rows of a block's words: two per byte, and some per word."""

    two: np.ndarray
    three: np.ndarray
    own: list[np.ndarray]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    transitions: np.ndarray
    lexicon: np.ndarray

    def features(self, data: np.ndarray, words: Words) -> Features:
        two, three = gram_rows(data, words)
        own = []
        for size in (2, 3):
            first, last = affix_keys(data, words, size)
            own += [row(first, 10 + size), row(last, 20 + size)]
        known = looked_up(words.hashes, self.lexicon, np.arange(len(self.lexicon)))
        own.append(np.where(known >= 0, row(words.hashes, 30), 0))
        return Features(two, three, own)

    def scores(self, f: Features, words: Words) -> np.ndarray:
        out = word_sums(self.table, f.two, words) + word_sums(self.table, f.three, words)
        for rows in f.own:
            out += self.table[rows]
        return out

    def marginals(self, scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return forward_backward(scores, self.transitions, bounds, pairs=False)[0]


def _normal(x: np.ndarray, axes: int = 1) -> np.ndarray:
    """Scaled to a sum of 1 over the last axes."""
    return x / x.sum(tuple(range(-axes, 0)), keepdims=True)


def forward_backward(scores: np.ndarray, transitions: np.ndarray, bounds: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Each word's distribution, and if asked the expected transitions, of sequences bounds[i] to bounds[i + 1].

    Sequences are cut into chunks. Each chunk's product of transfer matrices carries messages from chunk to chunk, then all chunks run
    inside at once: the result is exact, and the number of numpy calls depends on the chunk size and not on the words.
    """
    n, k = scores.shape
    if not n:
        return np.zeros((0, k)), np.zeros((k, k))
    psi = np.exp(np.maximum(scores - scores.max(1, keepdims=True), -60)).astype(np.float64)
    move = np.exp(transitions - transitions.max())
    lengths = np.diff(bounds)
    pieces = -(-lengths // CHUNK)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = bounds[:-1][owner] + rank * CHUNK
    size = np.minimum(CHUNK, bounds[1:][owner] - begin)
    order = np.argsort(-size, kind="stable")
    begin_o, size_o, inverse = begin[order], size[order], np.argsort(order, kind="stable")
    active = [int(np.searchsorted(-size_o, -s, side="left")) for s in range(CHUNK)]  # chunks longer than s
    first_chunk = (rank == 0)[order]

    product = np.tile(np.eye(k), (len(owner), 1, 1))
    for s in range(CHUNK):
        a = active[s]
        if not a:
            break
        step = (product[:a].reshape(-1, k) @ move).reshape(a, k, k)
        if s == 0:
            step[first_chunk[:a]] = np.eye(k)  # nothing comes before a sequence's first word
        product[:a] = _normal(step * psi[begin_o[:a] + s][:, None, :], 2)
    product = product[inverse]

    enter, leave = np.full((len(owner), k), 1.0 / k), np.full((len(owner), k), 1.0)
    starts = np.cumsum(pieces) - pieces
    for j in range(1, int(pieces.max(initial=0))):
        at = starts[pieces > j] + j
        enter[at] = _normal((enter[at - 1][:, None, :] @ product[at - 1])[:, 0])
    for j in range(int(pieces.max(initial=0)) - 2, -1, -1):
        at = starts[pieces > j + 1] + j
        leave[at] = _normal((product[at + 1] @ leave[at + 1][:, :, None])[:, :, 0])

    alpha, beta = np.empty((n, k)), np.empty((n, k))
    state = enter[order]
    for s in range(CHUNK):
        a = active[s]
        if not a:
            break
        moved = state[:a] @ move
        if s == 0:
            moved[first_chunk[:a]] = 1.0 / k
        state[:a] = _normal(moved * psi[begin_o[:a] + s])
        alpha[begin_o[:a] + s] = state[:a]
    state = leave[order]
    for s in range(CHUNK - 1, -1, -1):
        a = active[s]
        if not a:
            continue
        at = begin_o[:a] + s
        beta[at] = state[:a]
        if s:
            state[:a] = _normal((psi[at] * state[:a]) @ move.T)
    marginals = _normal(alpha * beta)
    if not pairs:
        return marginals, np.zeros((k, k))
    inner = np.ones(n, bool)
    inner[bounds[:-1][bounds[:-1] < n]] = False
    at = np.flatnonzero(inner)
    left, right = alpha[at - 1], psi[at] * beta[at]
    z = ((left @ move) * right).sum(1, keepdims=True)
    return marginals, move * ((left / z).T @ right)


def middle(text: str | None) -> str:
    """The middle WORDS words of a text, as it has them, and of these at most MOST_BYTES bytes; a longer word is cut."""
    words = find_words(*text_bytes(pa.array([text], pa.string())), LETTERS)
    if not len(words.start):
        return ""
    skip = max(0, (len(words.start) - WORDS) // 2)
    start, end = int(words.start[skip]), words.end[skip : skip + WORDS]
    fits = int(np.searchsorted(end, start + MOST_BYTES, side="right"))
    return text.encode()[start : int(end[fits - 1]) if fits else start + MOST_BYTES].decode(errors="ignore")


def train(texts: list[str], labels: list[str], seed: int = 5) -> Model:
    """Fits on at most WORDS words of each text; deterministic."""
    texts = [middle(t) for t in texts]
    languages = sorted(set(labels))
    rng, k = np.random.default_rng(seed), len(languages)
    model = Model(languages, np.zeros((1 << TABLE_BITS, max(k, 1)), np.float32), np.zeros((k, k)), np.zeros(0, np.uint64))
    if k < 2:
        return model
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    words = find_words(data, offsets, LETTERS)
    bounds, codes = words.bounds(), np.array([languages.index(x) for x in labels])
    pieces: list[list[np.ndarray]] = [[] for _ in languages]
    for i, code in enumerate(codes):
        a, b = int(bounds[i]), int(bounds[i + 1])
        pieces[code] += [np.arange(j, min(j + STRETCH, b)) for j in range(a, b, STRETCH)]
    pool = [(p, code) for code, own in enumerate(pieces) for p in own]
    if not pool:
        return model
    used = np.concatenate([p for p, _ in pool])
    seen, counts = np.unique(words.hashes[used], return_counts=True)
    model.lexicon = seen[counts >= LEAST]
    # From here on only the words used, in the order of shuffled stretches.
    shuffled = [pool[i] for i in rng.permutation(len(pool))]
    at = np.concatenate([p for p, _ in shuffled])
    gold = np.concatenate([np.full(len(p), code) for p, code in shuffled])
    lengths = np.array([len(p) for p, _ in shuffled])
    ends = np.cumsum(lengths)
    sequence = np.unique(np.concatenate([[0], ends[STRETCHES - 1 :: STRETCHES], [ends[-1]]]))
    f = model.features(data, words)
    size = (words.end - words.start)[at]
    word_of = np.repeat(np.arange(len(at)), size)
    byte = np.repeat(words.start[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    parts = [(f.two[byte], word_of), (f.three[byte], word_of)] + [(r[at], np.arange(len(at))) for r in f.own]
    onehot = np.eye(k)[gold]
    same = np.ones(len(at), bool)
    same[sequence[:-1]] = False
    pairs = np.zeros((k, k))
    np.add.at(pairs, (gold[np.flatnonzero(same) - 1], gold[same]), 1)
    square, square_t, rate = np.full(model.table.shape, 1e-6), np.full((k, k), 1e-6), 0.3
    for _ in range(ROUNDS):
        scores = np.zeros((len(at), k))
        for rows, owner in parts:
            values = model.table[rows]
            scores += np.stack([np.bincount(owner, values[:, c], len(at)) for c in range(k)], 1)
        marginals, expected = forward_backward(scores, model.transitions, sequence)
        error = (onehot - marginals) / len(at)
        gradient = np.zeros(model.table.shape)
        for rows, owner in parts:
            for c in range(k):
                gradient[:, c] += np.bincount(rows, error[owner, c], len(model.table))
        gradient[0] = 0
        gradient -= 1e-7 * model.table
        square += gradient**2
        model.table += (rate * gradient / np.sqrt(square)).astype(np.float32)
        moved = (pairs - expected) / len(at) - 1e-4 * model.transitions
        square_t += moved**2
        model.transitions += rate * moved / np.sqrt(square_t)
    return model


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def fit(docs: DataFrame, texts: int = TEXTS) -> Model:
    """Learns from at most texts labelled rows, none held out; only the middles of their texts come to the driver."""

    def middles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [middle(batch.column(1)[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.string()), batch.column(2)], names=["id", "text", "lang"])

    kind = dict(docs.dtypes)["doc_id"]
    picked = labelled_sample(docs.select("doc_id", F.col("lang").cast("string").alias("lang")), "lang", texts).select(F.col("doc_id").alias("own_id"), F.col("lang").alias("own_lang"))
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.join(F.broadcast(picked), (F.col("id") == F.col("own_id")) & (F.col("lang") == F.col("own_lang")), "left_semi")  # at most texts rows
    found = rows.mapInArrow(middles, f"id {kind}, text string, lang string").dropDuplicates().orderBy("id", "lang", "text").limit(texts).collect()
    return train([r.text for r in found], [r.lang for r in found])


def predict(model: Model, column: pa.Array) -> Iterator[tuple[str, float, int]]:
    """Language, score and number of words of each text."""
    for a, b in text_parts(column):
        part = column.slice(a, b - a)
        data, offsets = text_bytes(part)
        words = find_words(data, offsets, LETTERS)
        bounds = words.bounds()
        counts, mass = np.diff(bounds), np.zeros((b - a, len(model.languages)))
        if len(model.languages) and len(words.start):
            marginals = model.marginals(model.scores(model.features(data, words), words), bounds)
            full = np.flatnonzero(counts)
            mass[full] = np.add.reduceat(marginals, bounds[full], axis=0)
        for i in range(b - a):
            if not len(model.languages) or not counts[i] or not has_letter(part[i].as_py()):
                yield UNKNOWN, 0.0, int(counts[i])
            else:
                best = int(mass[i].argmax())
                yield model.languages[best], float(min(1.0, mass[i, best] / counts[i])), int(counts[i])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, words) for each row.

    lang_pred is UNKNOWN with score 0 for texts that are NULL or have no letter, and where no language was learned. Ties go to the language
    that sorts first. A row without doc_id counts as not held out, and is never learned from. lang, source and doc_id don't reach the
    prediction. Very long texts are read whole, a block at a time; repeated rows come out alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*predict(shared.value, batch.column(2)), strict=True)) or [(), (), ()]
            columns = [pa.array(v, k) for v, k in zip(found, (pa.string(), pa.float64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "held_out", "lang_pred", "score", "words"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(identified, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, words bigint")


def keep_known(docs: DataFrame, model: Model | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs, all columns, whose language is known with at least that score; nothing is shuffled.

    Texts that are NULL, empty or without letters go; very long ones are read whole, a block at a time; repeated rows stay or go alike. If no
    language was learned, all rows go.
    """
    shared, place = docs.sparkSession.sparkContext.broadcast(model or fit(docs)), docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from kept_rows(batch, np.array([p != UNKNOWN and s >= least for p, s, _ in predict(shared.value, batch.column(place))], bool), place)

    return docs.mapInArrow(kept, docs.schema)
