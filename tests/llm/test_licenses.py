"""Licence scans: base phrases against a plain search, templates on planted notices."""

import random
import re

import pytest

from corvane.llm import license_texts, licenses, texts

SCHEMA = "doc_id long, text string, labels string, score string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    starts, labels = [], set()
    for phrase, label in licenses.BASE.items():
        want = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(want)] == want:
                starts.append(i)
                labels.add(label)
    ends = (min(starts), max(starts)) if starts else (None, None)
    return len(words), len(starts), *ends, ",".join(sorted(labels))


def rows():
    draw = random.Random(2)
    pool = "under the mit license apache version 2 cc by nc 4 0 of is éa ß x9 UNDER The MIT".split()
    marks = [" ", ", ", "-", "\n", "\x00", "\x7f", "_"]
    out = ["".join(w + draw.choice(marks) for w in draw.choices(pool, k=draw.choice([0, 1, 5, 60, 900]))) for _ in range(150)]
    notice = "This work is licensed under the GNU General Public License, version 3."
    out += [None, "", "Released under the MIT License.", notice, "Licensed under CC BY-NC 4.0.", notice * 3]
    out += ["Permission is hereby granted, free of charge, to any person obtaining a copy"]
    out += ["the license of the public is general, the gnu has version 3", "the mit has a license", "x " * 2000 + notice]
    out += ["Redistribution and use in source and binary forms, with or without any modification", "mit", "nc by cc"]
    return list(enumerate(out))


def test_base_matches_plain_search_and_templates_are_found(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in data], SCHEMA)
    got = {r["doc_id"]: r for r in licenses.licenses(df).collect()}
    assert len(got) == len(data)
    for i, t in data:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert r["labels"] == ",".join(sorted(set(filter(None, r["labels"].split(","))))) and 0 <= r["score"] <= 1
    labels = [got[i]["labels"] for i, _ in data[150:]]
    assert labels == ["", "", "mit", "gpl-3", "cc-by-nc", "gpl-3", "mit", "", "", "gpl-3", "", "", ""]


def test_blocks_change_nothing(monkeypatch):
    index = licenses.Index(dict.fromkeys(licenses.VOCABULARY, 1.0))
    data = rows() + [(0, f"word {n} x " * 20 + text) for n, (_, text, _) in enumerate(license_texts.TEMPLATES)]
    whole = [licenses.scan((t or "").encode(), index) for _, t in data]
    small = lambda text: texts.word_blocks(text, 40)
    monkeypatch.setattr(licenses, "word_blocks", small)
    cut = [licenses.scan((t or "").encode(), index) for _, t in data]
    assert [w[:6] for w in whole] == [c[:6] for c in cut]


def test_frequencies_and_empty(spark):
    df = spark.createDataFrame([(1, "The MIT the", "", ""), (2, "the x", "", ""), (3, None, "", "")], SCHEMA)
    assert licenses.document_frequencies(df) == {b"": 3, b"the": 2, b"mit": 1}
    assert licenses.licenses(df.limit(0)).collect() == []


def rarities():
    """Corpora in which other words are the rare ones, among them that the words of short names are frequent."""
    words = sorted(licenses.VOCABULARY)
    draw = random.Random(8)
    common = {b"cc", b"by", b"sa", b"nc", b"mit", b"gnu"}
    yield dict.fromkeys(words, 1.0)
    yield {w: 0.1 if w in common else 5.0 for w in words}
    for _ in range(4):
        yield {w: draw.random() * 9 for w in words}


def plain_labels(text):
    """Every template at every place, its key phrases at their distances, by brute force."""
    words, found = licenses.words_of(text.encode()), set()
    for label, wording, keys in license_texts.TEMPLATES:
        own = licenses.words_of(wording.encode())
        phrases = [licenses.words_of(k.encode()) for k in keys]
        at = [next(i for i in range(len(own)) if own[i : i + len(p)] == p) for p in phrases]
        starts = [[i for i in range(len(words)) if words[i : i + len(p)] == p] for p in phrases]
        for first in starts[0]:
            room = [licenses.SLACK + (a - at[0]) // licenses.DRIFT for a in at]
            if all(any(abs(s - first - (a - at[0])) <= r for s in ss) for ss, a, r in zip(starts, at, room)):
                found.add(label)
    return found


@pytest.mark.parametrize("rarity", list(rarities()), ids=range(6))
def test_templates_in_long_mixed_texts(rarity):
    index = licenses.Index(rarity)
    draw = random.Random(11)
    pool = [w.decode() for w in sorted(licenses.VOCABULARY)] + "rain bread hills old stories".split()
    for round in range(120):
        parts = []
        for _, wording, keys in draw.sample(license_texts.TEMPLATES, k=draw.randint(0, 3)):
            words = draw.choice([wording, *keys]).split()
            for _ in range(draw.randint(0, 2)):  # a few words more or less
                at = draw.randrange(len(words))
                words[at : at + 1] = draw.choice([[], [words[at], "indeed"]])
            parts.append(" ".join(words))
        noise = [" ".join(draw.choices(pool, k=draw.randint(0, 200))) for _ in range(len(parts) + 1)]
        text = " ".join(x for pair in zip(noise, [*parts, ""]) for x in pair)
        base = set(filter(None, plain(text)[4].split(",")))
        assert licenses.scan(text.encode(), index)[5] == ",".join(sorted(plain_labels(text) | base))


@pytest.mark.parametrize("rarity", list(rarities()), ids=range(6))
def test_notices_as_their_authors_word_them(rarity):
    index = licenses.Index(rarity)
    other = " Also: licensed under terms, version 4.0 of the public license, 0 GNU names, by the way. "
    label = lambda text: licenses.scan((other * 3 + text + other * 3).encode(), index)[5]
    for wanted, wording, _ in license_texts.TEMPLATES:
        assert wanted in label(wording).split(",")
    assert label("CC BY-SA") == "cc-by-sa"
    gpl = "GNU General Public License as published by\n * the Free Software Foundation, either version {} of the License, or"
    assert label(gpl.format(3)) == "gpl-3" and label(gpl.format(2)) == "gpl-2"
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
    assert label(isc + ", provided that the above copyright notice and this permission notice appear in all copies.") == "isc"
    assert label(isc + ". The software is provided as is") == "0bsd"
    assert label("SPDX-License-Identifier: LGPL-2.1-or-later") == "lgpl-2.1"
