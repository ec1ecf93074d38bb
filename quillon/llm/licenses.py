"""License scans by a generalised suffix automaton over the words of licence templates.

The automaton has every run of words of every template. A text streams through it word by word, which gives at each word the length of the
longest run that ends there and stands in a template (its matching statistics). Runs of MIN_RUN words or more become anchors of the
templates that have them; per template, anchors in the same order in text and template, with few words between, chain into spans, and a
span that covers COVERAGE of a template's words carries its label. Base phrases are short templates that count wherever they stand whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import ALNUM, find_words, looked_up, text_bytes, text_parts, word_hash

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices and openings of public licences by label.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    "mit": (
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    ),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "gpl-3.0": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    ),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "cc-by-4.0": ("licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "proprietary": ("all rights reserved", "no part of this work may be reproduced without prior written permission"),
}
MIN_RUN, COVERAGE, MAX_GAP = 3, 0.8, 6


@dataclass
class Automaton:
    """A suffix automaton of several sequences of numbers; state 0 is the empty run."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: Ends (sequence, place) of the runs of each state.
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])

    @classmethod
    def of(cls, sequences: Sequence[Sequence[int]]) -> Automaton:
        out = cls()
        for number, sequence in enumerate(sequences):
            last = 0
            for place, symbol in enumerate(sequence):
                last = out._extend(last, symbol)
                out.ends[last].add((number, place))
        for state in sorted(range(1, len(out.link)), key=lambda s: -out.length[s]):
            if out.link[state] > 0:
                out.ends[out.link[state]] |= out.ends[state]
        return out

    def _state(self, length: int, like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(-1 if like is None else self.link[like])
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            there = self.next[last][symbol]
            return there if self.length[there] == self.length[last] + 1 else self._split(last, symbol, there)
        new, state = self._state(self.length[last] + 1), last
        while state >= 0 and symbol not in self.next[state]:
            self.next[state][symbol] = new
            state = self.link[state]
        if state < 0:
            self.link[new] = 0
        else:
            there = self.next[state][symbol]
            self.link[new] = there if self.length[there] == self.length[state] + 1 else self._split(state, symbol, there)
        return new

    def _split(self, state: int, symbol: int, there: int) -> int:
        copy = self._state(self.length[state] + 1, there)
        self.link[there] = copy
        while state >= 0 and self.next[state].get(symbol) == there:
            self.next[state][symbol] = copy
            state = self.link[state]
        return copy

    def statistics(self, symbols: Sequence[int]) -> Iterator[tuple[int, int]]:
        """After each symbol: the state and length of the longest run that ends there."""
        state, length = 0, 0
        for symbol in symbols:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state, length = self.next[state][symbol], length + 1
            else:
                state, length = 0, 0
            yield state, length


@dataclass
class Span:
    label: str
    first: int
    last: int
    covered: float


class Scanner:
    def __init__(self, base: Mapping[str, str] = BASE, templates: Mapping[str, Sequence[str]] = TEMPLATES, min_run: int = MIN_RUN, coverage: float = COVERAGE, max_gap: int = MAX_GAP) -> None:
        self.min_run, self.coverage, self.max_gap = min_run, coverage, max_gap
        phrases = [(p.split(), label, True) for p, label in base.items()] + [(t.split(), label, False) for label, texts in templates.items() for t in texts]
        words = sorted({w for p, _, _ in phrases for w in p})
        number = {w: i for i, w in enumerate(words)}
        hashes = word_hash(words, ALNUM)
        order = np.argsort(hashes)
        self.keys, self.numbers = hashes[order], order.astype(np.int64)
        self.sequences = [[number[w] for w in p] for p, _, _ in phrases]
        self.labels = [label for _, label, _ in phrases]
        self.automaton = Automaton.of(self.sequences)
        self.width = len(words)
        self.pairs = np.unique([a * self.width + b for s in self.sequences for a, b in zip(s, s[1:], strict=False)])
        self.single = any(len(s) == 1 for s in self.sequences)
        self.long = {i for i, p in enumerate(phrases) if not p[2]}
        self.whole = self._whole({i for i, p in enumerate(phrases) if p[2]})

    def _whole(self, base: set[int]) -> list[list[int]]:
        """For each state the base phrases that are its runs' suffixes, longest first."""
        own = [[n for n, place in ends if n in base and place == len(self.sequences[n]) - 1 and self.automaton.length[self.automaton.link[s]] < len(self.sequences[n]) <= self.automaton.length[s]] if s else [] for s, ends in enumerate(self.automaton.ends)]
        out: list[list[int]] = [[] for _ in own]
        for s in sorted(range(1, len(own)), key=self.automaton.length.__getitem__):
            out[s] = own[s] + out[self.automaton.link[s]]
        return out

    def stretches(self, numbers: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int]]:
        """Maximal stretches of words in which every neighbouring pair stands in some template: longer runs are only there."""
        if self.single:
            known = (numbers >= 0).astype(np.int8)
            joined = (known[1:] & known[:-1]) & (doc[1:] == doc[:-1])
        elif len(numbers) > 1:
            pair = np.where((numbers[1:] >= 0) & (numbers[:-1] >= 0) & (doc[1:] == doc[:-1]), numbers[:-1] * self.width + numbers[1:], -1)
            joined = np.isin(pair, self.pairs)
        else:
            return
        edge = np.diff(np.concatenate([[0], joined.astype(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        if self.single:
            covered = np.zeros(len(numbers), bool)
            for a, b in zip(starts, ends, strict=True):
                covered[a:b] = True
            lone = np.flatnonzero((numbers >= 0) & ~covered)
            starts, ends = np.sort(np.concatenate([starts, lone])), np.sort(np.concatenate([ends, lone + 1]))
        yield from zip(starts.tolist(), ends.tolist(), strict=True)

    def read(self, symbols: list[int], offset: int, places: list[tuple[int, int]], anchors: dict[int, list[tuple[int, int, int]]]) -> None:
        """Adds the base phrases (phrase, start) and, by template, the anchors (start in text, start in template, length)."""
        found = list(self.automaton.statistics(symbols))
        for i, (state, length) in enumerate(found):
            for n in self.whole[state]:
                if len(self.sequences[n]) <= length:
                    places.append((n, offset + i - len(self.sequences[n]) + 1))
            if length >= self.min_run and (i + 1 == len(found) or found[i + 1][1] != length + 1):
                for n, place in self.automaton.ends[state]:
                    if n in self.long:
                        anchors[n].append((offset + i - length + 1, place - length + 1, length))

    def chain(self, n: int, anchors: list[tuple[int, int, int]]) -> list[Span]:
        """Spans of template n: best chains of anchors, each word once; a chain's neighbours are within max_gap words of each other."""
        size, anchors = len(self.sequences[n]), sorted(anchors)
        best: list[tuple[int, int]] = []  # covered words, first word of the chain
        taken: dict[int, tuple[int, int, int]] = {}  # by first word: covered, last word
        low = 0
        for i, (at, place, length) in enumerate(anchors):
            top = (length, at)
            while anchors[low][0] + size + self.max_gap < at:
                low += 1
            for j in range(low, i):
                at_2, place_2, length_2 = anchors[j]
                over = max(0, at_2 + length_2 - at, place_2 + length_2 - place)
                if at_2 < at and place_2 < place and over < length and at - at_2 - length_2 <= self.max_gap:
                    top = max(top, (best[j][0] + length - over, best[j][1]), key=lambda x: x[0])
            best.append(top)
            covered, first = top
            if covered / size >= self.coverage and covered > taken.get(first, (0, 0))[0]:
                taken[first] = (covered, at + length - 1)
        return [Span(self.labels[n], first, last, min(1.0, covered / size)) for first, (covered, last) in sorted(taken.items())]

    def scan(self, column: pa.Array) -> Iterator[tuple[int, list[tuple[int, int]], list[Span], float]]:
        """For each text: words, base places, spans, and the largest part of a template that a chain covers."""
        for a, b in text_parts(column):
            words = find_words(*text_bytes(column.slice(a, b - a)), ALNUM)
            bounds = words.bounds()
            numbers = looked_up(words.hashes, self.keys, self.numbers)
            places: dict[int, list] = defaultdict(list)
            anchors: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
            for i, j in self.stretches(numbers, words.doc):
                d = int(words.doc[i])
                self.read(numbers[i:j].tolist(), i - int(bounds[d]), places[d], anchors[d])
            for d in range(b - a):
                spans = [s for n, found in anchors[d].items() for s in self.chain(n, found)] if d in anchors else []
                yield int(bounds[d + 1] - bounds[d]), places.get(d, []), spans, max([s.covered for s in spans], default=0.0)


SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.float64())]))


def scan_licenses(docs: DataFrame, scanner: Scanner | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key, n_words, n_base, first_word, last_word, base_labels, labels, score, and spans of templates.

    NULL text is empty: no words, no labels, score 0, first_word and last_word NULL. score is the largest covered part of a template or, if a
    base phrase stands in the text, 1. Overlapping places all count. Templates are a parameter of the program, so their automaton travels with
    the function. Repeated rows come out alike, each; other columns aren't read.
    """
    scanner = scanner or Scanner()

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for n, places, spans, covered in scanner.scan(batch.column(1)):
                own = {scanner.labels[p] for p, _ in places}
                starts = [s for _, s in places]
                row = (n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {s.label for s in spans})), 1.0 if places else covered)
                for c, v in zip(out, (*row, [{"label": s.label, "first_word": s.first, "last_word": s.last, "covered": s.covered} for s in spans]), strict=True):
                    out[c].append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), SPANS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], names=[key, *out])

    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,first_word:bigint,last_word:bigint,covered:double>>"
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(scanned, schema)
