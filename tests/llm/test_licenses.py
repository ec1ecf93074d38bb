import random
import re

import pyarrow as pa
import pytest

from quillon.llm import licenses


def lower_words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def places(words):
    out = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return out


def test_matching_statistics():
    rng = random.Random(3)
    sequences = [[rng.randrange(4) for _ in range(rng.randint(1, 9))] for _ in range(6)] + [[0, 0, 0, 0], [0, 0]]
    automaton = licenses.Automaton.of(sequences)
    inside = lambda run: any(s[i : i + len(run)] == run for s in sequences for i in range(len(s) - len(run) + 1))
    for _ in range(200):
        text = [rng.randrange(5) for _ in range(rng.randint(0, 15))]
        for i, (state, length) in enumerate(automaton.statistics(text)):
            assert length == max(n for n in range(i + 2) if inside(text[i + 1 - n : i + 1]))
            run = text[i + 1 - length : i + 1]
            if length:
                assert automaton.ends[state] == {(n, j + length - 1) for n, s in enumerate(sequences) for j in range(len(s) - length + 1) if s[j : j + length] == run}


TEXTS = [
    "All rights reserved. All Rights Reserved",
    "x CC BY-NC 4.0, the GNU General Public License; cc-by",
    "Licensed under the Apache License, Version 2.0.",
    "licensed under the apache version 2.0",
    "cc", "", None, "all rights all rights reserved reserved", "Public license general public license",
]


def test_base_places_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "the", "é", "4"]
    texts = TEXTS + [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan_licenses(df).collect():
        words = lower_words(texts[r.doc_id])
        found = places(words)
        assert (r.n_words, r.n_base) == (len(words), len(found))
        assert (r.first_word, r.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1


@pytest.mark.parametrize(
    "text, label",
    [
        ("foo Licensed under the Apache License, Version 2.0. bar", "apache-2.0"),
        ("Released under the MIT License.", "mit"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
        ("licensed under the new apache license version 2 0", "apache-2.0"),
        ("Permission is hereby granted, free of charge, to any person getting a copy of this software and associated documentation files, to deal in the software without restriction", "mit"),
    ],
)
def test_templates(text, label):
    (_, _, spans, _), = licenses.Scanner().scan(pa.array([text]))
    assert label in {s.label for s in spans}
    assert all(0 <= s.first <= s.last < len(lower_words(text)) and s.covered >= licenses.COVERAGE for s in spans)


def test_plain_text_has_no_label():
    (_, found, spans, score), = licenses.Scanner().scan(pa.array(["permission to copy the license of a person is not granted in the version"]))
    assert (found, spans, score) == ([], [], 0.0)


def test_one_word_phrases():
    scanner = licenses.Scanner(base={"gpl": "gpl", "cc by": "cc-by"}, templates={})
    (_, found, _, _), = scanner.scan(pa.array(["gpl x cc by gpl gpl"]))
    assert sorted(at for _, at in found) == [0, 2, 4, 5]


def test_odd_rows(odd, none):
    out = licenses.scan_licenses(odd)
    assert out.count() == odd.count() and licenses.scan_licenses(none).count() == 0
    assert out.where("doc_id IN (2, 3) AND n_words = 0 AND labels = '' AND score = 0 AND first_word IS NULL").count() == 2


def spots(run, words):
    return [i for i in range(len(words) - len(run) + 1) if words[i : i + len(run)] == run]


def longest_runs(words, phrases):
    """(first word, words) of the longest runs of phrases that end at a word and don't go on, of MIN_RUN words or more."""
    longest = [max((n for n in range(1, i + 2) if any(spots(words[i + 1 - n : i + 1], p) for p in phrases)), default=0) for i in range(len(words))] + [0]
    return [(i + 1 - n, n) for i, n in enumerate(longest[:-1]) if n >= licenses.MIN_RUN and longest[i + 1] != n + 1]


def all_chains(words, template, runs):
    """(first word, last word, covered words) of every chain of anchors in a template, by plain enumeration."""
    anchors = [(at, place, n) for at, n in runs for place in spots(words[at : at + n], template)]

    def longer(first, covered, end):
        yield first, end[0] + end[2] - 1, covered
        for at, place, n in anchors:
            shared = max(0, end[0] + end[2] - at, end[1] + end[2] - place)
            if at > end[0] and place > end[1] and shared < n and at - end[0] - end[2] <= licenses.MAX_GAP:
                yield from longer(first, covered + n - shared, (at, place, n))

    for a in anchors:
        yield from longer(a[0], a[2], a)


def test_chains_and_scores_equal_brute_force(spark):
    rng = random.Random(5)
    templates = [(label, t.split()) for label, texts in licenses.TEMPLATES.items() for t in texts]
    phrases = [t for _, t in templates] + [p.split() for p in licenses.BASE]
    texts = []
    for _ in range(250):
        words = []
        for _, own in rng.sample(templates, rng.randint(1, 2)):
            own = list(own)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                at = rng.randrange(len(own) + 1)
                own[at : at + rng.randint(0, 2)] = rng.choices(["x", "the", "license", "4", *own], k=rng.choice([0, 1, 2, 7]))
            words += rng.choices(["y", "of", "public"], k=rng.randint(0, 3)) + own
        texts.append(" ".join(words))
    scores = []
    for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        words = texts[r.doc_id].split()
        runs = longest_runs(words, phrases)
        chains = {(label, first, last, min(1.0, n / len(t))) for label, t in templates for first, last, n in all_chains(words, t, runs) if n / len(t) >= licenses.COVERAGE}
        based = {x for _, x in places(words)}
        assert {s.label for s in r.spans} == {c[0] for c in chains}
        assert {(s.label, s.first_word, s.last_word, s.covered) for s in r.spans} <= chains
        assert r.labels == ",".join(sorted({c[0] for c in chains} | based))
        assert max((s.covered for s in r.spans), default=0.0) == max((c[3] for c in chains), default=0.0)
        assert r.score == (1.0 if based else max((c[3] for c in chains), default=0.0))
        scores.append(r.score)
    assert 0 < sum(s == 0 for s in scores) < 250 and any(0 < s < 1 for s in scores)
