"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as word inputs (its log-odds and vector in a lexicon of training words) and as character inputs (the largest log-odds and the
mean vector of its bytes' four-grams, word ends included). The network reads windows of WINDOW words, each overlapping the next by half, in
both directions; attention pools a window's states to one logit, and a text's score is that of its highest window. Only texts carry labels,
so training picks each text's highest windows every few rounds and learns from them: the network, the word vectors and the four-gram vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import LOWER, Words, find_words, looked_up, rolled, text_bytes, text_parts
from quillon.llm.features import LETTERS, held_out, labelled_sample

WINDOW, STRIDE, HIDDEN = 32, 16, 6
THRESHOLD = 0.3
#: Bounds of training: texts of each label, bytes of a text (of a longer one, as many stretches from all over), texts that a lexicon word
#: stands in at least, rounds.
TOXIC, CLEAN, MOST_BYTES, STRETCHES, LEAST, ROUNDS = 1000, 3000, 16_000, 16, 3, 12
#: Steps of the word and four-gram vectors.
WORD_RATE, GRAM_RATE = 0.2, 2.0
CLEAN_WINDOWS = 3
GRAM_BITS, GRAM_SIZE, WORD_SIZE = 18, 3, 4
#: Words in windows that run through the network at once.
BATCH = 2048 * WINDOW


def gram_rows(data: np.ndarray, words: Words) -> np.ndarray:
    """For each byte the table row of the four bytes from the one before it on; bytes outside the word count as a space, row 0 is none."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[words.start] += 1
    inside[words.end] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    shown = np.full(len(data) + 3, 32, np.uint32)
    shown[1:-2] = np.where(inside, LOWER[data], 32)
    key = (shown[:-3] << np.uint32(24)) | (shown[1:-2] << np.uint32(16)) | (shown[2:-1] << np.uint32(8)) | shown[3:]
    rows = (key * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)
    return np.where(inside, np.maximum(rows, 1), 0).astype(np.int32)


def word_bytes(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the bytes of some words, one word after the other, and their numbers."""
    size = (words.end - words.start)[which]
    return np.repeat(words.start[which] - (np.cumsum(size) - size), size) + np.arange(size.sum()), size


def windows_of(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and length of all windows: at every STRIDE words, the last ending with the text."""
    lengths = np.diff(bounds)
    count = np.where(lengths > 0, np.maximum(1, -(-(lengths - WINDOW) // STRIDE) + 1), 0)
    text = np.repeat(np.arange(len(lengths)), count)
    rank = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = bounds[:-1][text] + rank * STRIDE
    return text, first, np.minimum(WINDOW, bounds[1:][text] - first)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """x (windows, steps, inputs) to logits; parameters by name in p."""

    def __init__(self, inputs: int, hidden: int = HIDDEN, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.hidden = hidden
        self.p = {"a": normal(2 * hidden, hidden), "v": normal(hidden, 1)[:, 0], "o": normal(2 * hidden, 1)[:, 0], "c": np.full(1, -2, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": normal(inputs, 3 * hidden), f"u{d}": normal(hidden, 3 * hidden), f"s{d}": np.zeros(3 * hidden, np.float32)}

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Both directions' inputs to the gates for each word, computed once for all windows that the word is in."""
        return {d: x @ self.p[f"w{d}"] + self.p[f"s{d}"] for d in "fb"}

    def run(self, gates: dict[str, np.ndarray], first: np.ndarray, length: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows, which must come longest first; with keep also what the way back needs."""
        n, h, steps = len(first), self.hidden, int(length.max(initial=0))
        active = [int(np.searchsorted(-length, -t, side="left")) for t in range(steps)]
        states = np.zeros((steps, n, 2 * h), np.float32)
        trace: dict = {}
        for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            part = slice(0, h) if d == "f" else slice(h, 2 * h)
            state, u = np.zeros((n, h), np.float32), self.p[f"u{d}"]
            for t in order:
                a = active[t]
                x, before = gates[d][first[:a] + t], state[:a].copy() if keep else state[:a]
                r = before @ u
                zr = x[:, : 2 * h] + r[:, : 2 * h]
                zr *= 0.5  # the logistic function by way of tanh
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                z, reset = zr[:, :h], zr[:, h:]
                new = reset * r[:, 2 * h :]
                new += x[:, 2 * h :]
                np.tanh(new, out=new)
                out = before - new
                out *= z
                out += new
                if keep:
                    trace[d, t] = (before, z, reset, new, r[:, 2 * h :].copy())
                state[:a] = out
                states[t, :a, part] = out
        mixed = np.tanh(states @ self.p["a"])
        weight = mixed @ self.p["v"]
        weight[np.arange(steps)[:, None] >= length] = -1e9
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = (weight[:, :, None] * states).sum(0)
        trace |= {"states": states, "mixed": mixed, "weight": weight, "pooled": pooled} if keep else {}
        return pooled @ self.p["o"] + self.p["c"][0], trace

    def back(self, d_logit: np.ndarray, trace: dict, gates: dict[str, np.ndarray], first: np.ndarray, length: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Gradients of the parameters but w and s, and of the gates' inputs."""
        p, h = self.p, self.hidden
        states, mixed, weight, pooled = (trace[k] for k in ("states", "mixed", "weight", "pooled"))
        steps = len(states)
        g = {"o": pooled.T @ d_logit, "c": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["o"]
        d_weight = (states * d_pooled).sum(2)
        d_states = weight[:, :, None] * d_pooled
        d_scores = weight * (d_weight - (weight * d_weight).sum(0))
        d_mixed = d_scores[:, :, None] * p["v"] * (1 - mixed**2)
        g["v"] = np.einsum("tnh,tn->h", mixed, d_scores)
        g["a"] = np.einsum("tni,tnj->ij", states, d_mixed)
        d_states = d_states + d_mixed @ p["a"].T
        d_gates = {}
        for d, order in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
            part = slice(0, h) if d == "f" else slice(h, 2 * h)
            u, d_u, d_in = p[f"u{d}"], np.zeros_like(p[f"u{d}"]), np.zeros_like(gates[d])
            after = np.zeros((len(first), h), np.float32)
            for t in order:
                before, z, reset, new, r = trace[d, t]
                a = len(before)
                d_out = after[:a] + d_states[t, :a, part]
                d_new = d_out * (1 - z) * (1 - new**2)
                d_z, d_reset = d_out * (before - new) * z * (1 - z), d_new * r * reset * (1 - reset)
                np.add.at(d_in, first[:a] + t, np.concatenate([d_z, d_reset, d_new], 1))
                d_r = np.concatenate([d_z, d_reset, d_new * reset], 1)
                d_u += before.T @ d_r
                after[:a] = d_out * z + d_r @ u.T
            g[f"u{d}"], d_gates[d] = d_u, d_in
        return g, d_gates


class Adam:
    def __init__(self, rate: float) -> None:
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, x in g.items():
            self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * x
            self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * x * x
            p[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)


@dataclass
class Model:
    """lexicon: sorted word hashes; word_table and gram_table: log-odds, then the vector. Row 0 of both is for what isn't known."""

    lexicon: np.ndarray
    word_table: np.ndarray
    gram_table: np.ndarray
    network: Network

    def inputs(self, data: np.ndarray, words: Words) -> np.ndarray:
        if not len(words.start):
            return np.zeros((0, 2 + WORD_SIZE + GRAM_SIZE), np.float32)
        rows = gram_rows(data, words)
        grams = self.gram_table[rows]
        top = np.maximum.reduceat(grams[:, 0], words.start)
        mean = np.add.reduceat(grams[:, 1:], words.start, axis=0) / (words.end - words.start)[:, None]
        known = looked_up(words.hashes, self.lexicon, np.arange(1, len(self.lexicon) + 1), 0)
        return np.concatenate([top[:, None], mean, self.word_table[known]], 1).astype(np.float32)

    def logits(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The highest logit of each text's windows; -inf for texts without words."""
        text, first, length = windows_of(bounds)
        out, gates, step = np.full(len(bounds) - 1, -np.inf), self.network.project(x), max(1, BATCH // WINDOW)
        order = np.argsort(-length, kind="stable")
        for i in range(0, len(order), step):
            at = order[i : i + step]
            np.maximum.at(out, text[at], self.network.run(gates, first[at], length[at])[0])
        return out


def text_counts(rows: np.ndarray, owner: np.ndarray, toxic: np.ndarray, size: int) -> np.ndarray:
    """For each row the numbers of toxic and of other texts it stands in."""
    pairs = np.unique(rows.astype(np.int64) * len(toxic) + owner)
    at, text = pairs // len(toxic), pairs % len(toxic)
    return np.stack([np.bincount(at, toxic[text], size), np.bincount(at, 1 - toxic[text], size)])


def novel_words(hashes: np.ndarray, doc: np.ndarray, size: int = 5) -> np.ndarray:
    """Words at which a run of size words begins that no earlier text has (the last words of a text go with its last run).

    Copies and passages repeated across texts so count once, and chance words in a copied toxic text don't look toxic.
    """
    shingles, at = rolled(hashes, doc, size)
    out = np.ones(len(hashes), bool)
    first = np.zeros(len(at), bool)
    first[np.unique(shingles, return_index=True)[1]] = True
    out[at] = first
    last = np.flatnonzero(np.diff(np.append(doc, -1)))  # of each text
    for k in range(size - 1, 0, -1):
        place = last - k + 1
        ok = (place > 0) & (place <= last)
        place = place[ok]
        place = place[(doc[place] == doc[place - 1]) & (doc[np.minimum(place + k - 1, len(doc) - 1)] == doc[place])]
        out[place] = out[place - 1]
    return out


def log_odds(counts: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Log-odds of toxic among the texts of a row against all texts, drawn to 0 where they are few."""
    a, b = counts
    odds = np.log((a + 0.5) / (toxic.sum() + 1)) - np.log((b + 0.5) / ((1 - toxic).sum() + 1))
    return np.clip(odds * (a + b) / (a + b + 12), -2, 4)


def highest(text: np.ndarray, value: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Each toxic text's highest window and each other text's CLEAN_WINDOWS highest."""
    order = np.lexsort((-value, text))
    start = np.unique(text[order], return_index=True)[1]
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[rank < np.where(toxic[text[order]] == 1, 1, CLEAN_WINDOWS)]


def train(texts: list[str], labels: list[int], prior: float | None = None, rounds: int = ROUNDS, seed: int = 3) -> Model:
    """prior: the share of toxic texts that scores should reflect, if not that of the sample. Deterministic."""
    rng, toxic = np.random.default_rng(seed), np.array(labels, np.float64)
    column = pa.array(texts, pa.string())
    parts = list(text_parts(column, 1 << 20))  # features of bytes are held for one part at a time

    def each() -> Iterator[tuple[int, np.ndarray, np.ndarray, Words]]:
        for a, b in parts:
            data, offsets = text_bytes(column.slice(a, b - a))
            yield a, data, offsets, find_words(data, offsets, LETTERS)

    found = [(w.hashes, w.doc + a) for a, _, _, w in each()]
    hashes = np.concatenate([h for h, _ in found]) if found else np.zeros(0, np.uint64)
    doc = np.concatenate([d for _, d in found]) if found else np.zeros(0, np.int64)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    del found
    seen, counts = np.unique(hashes, return_counts=True)
    lexicon = seen[counts >= LEAST]
    del seen, counts
    word_table = np.zeros((len(lexicon) + 1, 1 + WORD_SIZE), np.float32)
    gram_table = np.zeros((1 << GRAM_BITS, 1 + GRAM_SIZE), np.float32)
    model = Model(lexicon, word_table, gram_table, Network(2 + WORD_SIZE + GRAM_SIZE, seed=seed))
    if not len(hashes) or toxic.min() == toxic.max():
        model.network.p["o"][:] = 0
        model.network.p["c"][:] = 6 if len(toxic) and toxic.min() == 1 else -6
        return model
    known = looked_up(hashes, lexicon, np.arange(1, len(lexicon) + 1), 0)
    novel = novel_words(hashes, doc)
    word_table[:, 0] = log_odds(text_counts(np.where(novel, known, 0), doc, toxic, len(word_table)), toxic)
    gram_counts, at = np.zeros((2, len(gram_table))), 0
    for a, data, offsets, words in each():
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) + a
        new = np.repeat(novel[at : at + len(words.start)], words.end - words.start)
        rows = gram_rows(data, words)
        rows[np.flatnonzero(rows)[~new]] = 0
        gram_counts += text_counts(rows, owner, toxic, len(gram_table))
        at += len(words.start)
    gram_table[:, 0] = log_odds(gram_counts, toxic)
    word_table[0] = gram_table[0] = 0
    word_table[1:, 1:] = rng.normal(size=(len(lexicon), WORD_SIZE)) * 0.1
    gram_table[1:, 1:] = rng.normal(size=(len(gram_table) - 1, GRAM_SIZE)) * 0.1
    share = toxic.mean() if prior is None else min(max(prior, 0.01), 0.99)
    weight = np.where(toxic == 1, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    text, first, length = windows_of(bounds)
    net, adam, g1 = model.network, Adam(0.02), 1 + GRAM_SIZE
    x = np.empty((len(hashes), 2 + WORD_SIZE + GRAM_SIZE), np.float32)
    for turn in range(rounds):
        if turn % 3 == 0:  # pick each text's highest window anew
            at = 0
            for _, data, _, words in each():
                x[at : at + len(words.start)] = model.inputs(data, words)
                at += len(words.start)
            logit = np.empty(len(text))
            for i in range(0, len(text), BATCH // WINDOW):  # windows are in the order of their words
                at = np.arange(i, min(len(text), i + BATCH // WINDOW))
                low, high = first[at[0]], (first[at] + length[at]).max()
                at = at[np.argsort(-length[at], kind="stable")]
                logit[at] = net.run(net.project(x[low:high]), first[at] - low, length[at])[0]
            best = highest(text, logit, toxic)
            if turn == 0:  # before anything is learned, the window with the largest log-odds
                odds = np.maximum(x[:, 0], x[:, g1])
                lead = np.max([odds[first + np.minimum(t, length - 1)] for t in range(WINDOW)], 0)
                best = highest(text, lead, toxic)
            # Four-grams of the words in these windows, by number of the word.
            used, sizes, grams, at = np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int32), [], 0
            for t in range(WINDOW):
                used[first[best] + np.minimum(t, length[best] - 1)] = True
            for _, data, _, words in each():
                own = np.flatnonzero(used[at : at + len(words.start)])
                place, sizes[at + own] = word_bytes(words, own)
                grams.append(gram_rows(data, words)[place])
                at += len(words.start)
            grams, begins = np.concatenate(grams), np.cumsum(sizes, dtype=np.int64) - sizes
            del data, words, place
        best = rng.permutation(best)
        for i in range(0, len(best), 256):
            at = best[i : i + 256]
            at = at[np.argsort(-length[at], kind="stable")]
            # Only the batch's words go through the gates.
            own = (first[at][:, None] + np.minimum(np.arange(WINDOW), length[at][:, None] - 1)).ravel()
            local_first = np.arange(len(at)) * WINDOW
            size = sizes[own]
            rows = grams[np.repeat(begins[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            part = x[own]
            part[:, 1:g1] = np.add.reduceat(gram_table[rows, 1:], np.cumsum(size) - size, axis=0) / size[:, None]
            part[:, g1 + 1 :] = word_table[known[own], 1:]
            gates = net.project(part)
            logit, trace = net.run(gates, local_first, length[at], keep=True)
            d_logit = ((sigmoid(logit) - toxic[text[at]]) * weight[text[at]] / len(at)).astype(np.float32)
            g, d_gates = net.back(d_logit, trace, gates, local_first, length[at])
            for d in "fb":
                g[f"w{d}"], g[f"s{d}"] = part.T @ d_gates[d] + 1e-4 * net.p[f"w{d}"], d_gates[d].sum(0)
            d_x = sum(d_gates[d] @ net.p[f"w{d}"].T for d in "fb")
            adam.step(net.p, g)
            np.add.at(word_table[:, 1:], known[own], -WORD_RATE * d_x[:, g1 + 1 :])
            np.add.at(gram_table[:, 1:], rows, np.repeat(-GRAM_RATE * d_x[:, 1:g1] / size[:, None], size, axis=0).astype(np.float32))
            word_table[0] = gram_table[0] = 0
    return model


def stretches(text: str | None) -> str:
    """A text of at most MOST_BYTES bytes as it is; of a longer one STRETCHES pieces from all over, in order."""
    data = (text or "").encode()
    if len(data) <= MOST_BYTES:
        return text or ""
    size = MOST_BYTES // STRETCHES
    return " ".join(data[at : at + size].decode(errors="ignore") for at in np.linspace(0, len(data) - size, STRETCHES).astype(int))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from at most TOXIC and CLEAN labelled texts, none held out; only stretches of them come to the driver."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [stretches(batch.column(1)[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2)], names=["id", "text", "toxic"])

    kind = dict(docs.dtypes)["doc_id"]
    flags = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1)").dropDuplicates()
    ids = labelled_sample(flags.where("toxic = 1"), "toxic", TOXIC).unionByName(labelled_sample(flags.where("toxic = 0"), "toxic", CLEAN))
    counts = flags.where(~held_out(F.col("doc_id"))).agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    joined = rows.join(F.broadcast(ids), F.col("id") == F.col("doc_id")).select("id", "text", "toxic")  # at most TOXIC + CLEAN rows
    found = joined.mapInArrow(cut, f"id {kind}, text string, toxic int").dropDuplicates().orderBy("id", "toxic", "text").limit(TOXIC + CLEAN).collect()
    return train([r.text for r in found], [r.toxic for r in found], counts[1] / counts[0] if counts[0] else None)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, words) for each row.

    A NULL text, or one without words, has score 0. Whole texts are read, block by block, and all their windows count; repeated rows come
    out alike. Labels, lang, source and doc_id don't reach the score; a row without doc_id counts as not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            column, out, n_words = batch.column(2), [], []
            for a, b in text_parts(column, 1 << 20):
                data, offsets = text_bytes(column.slice(a, b - a))
                words = find_words(data, offsets, LETTERS)
                bounds = words.bounds()
                logit = model.logits(model.inputs(data, words), bounds)
                out.append(np.where(np.isfinite(logit), sigmoid(logit), 0.0))
                n_words.append(np.diff(bounds))
            scores = np.concatenate(out) if out else np.zeros(0)
            counts = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32()), pa.array(counts, pa.int64())],
                names=["doc_id", "held_out", "score", "predicted", "words"],
            )

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("__flag"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scored, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int, words bigint")
