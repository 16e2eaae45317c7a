"""Licence scans with a positional index of rare words.

Words are counted over the corpus first: how many documents have each word of
the licences' key phrases. By these counts every key phrase is indexed under its
rarest words with their positions in it, so what else a text holds never crowds
a phrase out. A document's licence words are looked up from the rarest on: a
phrase led by the word is a candidate if its other rare words are there too, and
the places where it would begin, as each of them tells, are intersected. What is
left is verified word by word. A template counts where all its key phrases stand
at their distances from each other, a few words more or less.

Independent of that, the base phrases are found wherever their words stand
consecutively; their labels always stay.

Defined results. NULL text reads as empty: no words, no labels, score 0. The
score is the largest share of a template's words that stand in place, 1 for a
base phrase. Labels are distinct, sorted and joined by commas; none is an empty
string. Repeated rows get the same result; an empty table gives no rows. Only
the named columns are read. A text is held a block of words at a time, with the
last words of the block before.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.llm.license_texts import TEMPLATES
from corvane.llm.texts import word_blocks

# Fixed values of the contract.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

RARE = 3  # words of a key phrase by which it is looked up
SLACK = 3  # words missing or added between key phrases, and one more in so many words:
DRIFT = 10

_LETTERS = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b in _LETTERS else 0x20 for b in range(256)
)


def words_of(block: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of other signs than ASCII's."""
    return block.translate(_FOLD).split()


class Template(NamedTuple):
    label: str
    words: list[bytes]
    keys: list[tuple[int, int]]  # place in the template and number of each key phrase


def _templates(texts: list[tuple[str, str, list[str]]]) -> tuple[list[Template], list[list[bytes]]]:
    """Templates and the different key phrases of all of them."""
    phrases: list[list[bytes]] = []
    found = []
    for label, text, keys in texts:
        words, placed = words_of(text.encode()), []
        for key in keys:
            phrase = words_of(key.encode())
            at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
            if phrase not in phrases:
                phrases.append(phrase)
            placed.append((at, phrases.index(phrase)))
        found.append(Template(label, words, placed))
    return found, phrases


_TEMPLATES, _PHRASES = _templates(TEMPLATES)
_BASE = [(p.encode().split(), label) for p, label in BASE.items()]
VOCABULARY = frozenset(w for p in _PHRASES for w in p) | frozenset(w for p, _ in _BASE for w in p)
CARRY = max(len(t.words) for t in _TEMPLATES) * (DRIFT + 1) // DRIFT + SLACK  # words seen again with the next block


class Index:
    """Key phrases under the rarest of their words, with the words' positions."""

    def __init__(self, rarity: dict[bytes, float]):
        self.rarity = rarity
        self.led: dict[bytes, list[int]] = {}
        self.postings: list[list[tuple[bytes, int]]] = []
        for number, phrase in enumerate(_PHRASES):
            rare = sorted(set(phrase), key=lambda w: (-rarity[w], w))[:RARE]
            self.postings.append([(w, at) for w in rare for at in range(len(phrase)) if phrase[at] == w])
            self.led.setdefault(rare[0], []).append(number)
        self.uses: dict[int, list[Template]] = {}
        for template in _TEMPLATES:
            self.uses.setdefault(template.keys[0][1], []).append(template)

    def offered(self, present: frozenset[bytes]) -> list[int]:
        """Key phrases whose rare words are all there, looked up by the rarest words of the text."""
        rarest = sorted(present.intersection(self.led), key=lambda w: (-self.rarity[w], w))
        return [n for word in rarest for n in self.led[word] if all(w in present for w, _ in self.postings[n])]

    def stands(self, number: int, words: list[bytes], places: dict[bytes, list[int]]) -> list[int]:
        """Where a key phrase begins, in order."""
        (word, own), *others = self.postings[number]
        starts = {at - own for at in places[word]}
        for word, own in others:
            starts.intersection_update([at - own for at in places[word]])
        phrase = _PHRASES[number]
        return sorted(s for s in starts if s >= 0 and words[s : s + len(phrase)] == phrase)

    def matches(self, words: list[bytes], standing: dict[int, list[int]]) -> Iterator[tuple[str, float]]:
        """``label, share`` of every place of a template whose key phrases all stand where they should."""
        for first in standing:
            for template in self.uses.get(first, ()):
                at, _ = template.keys[0]
                for start in standing[first]:
                    if all(self._near(standing.get(n, ()), start, own - at) for own, n in template.keys[1:]):
                        begin = start - at
                        here = words[max(begin, 0) : begin + len(template.words)]
                        stand = sum(map(eq, here, template.words[max(-begin, 0) :]))
                        yield template.label, stand / len(template.words)

    @staticmethod
    def _near(starts: list[int], start: int, distance: int) -> bool:
        room = SLACK + abs(distance) // DRIFT
        at = bisect_left(starts, start + distance - room)
        return at < len(starts) and starts[at] <= start + distance + room


def scan(text: bytes, index: Index) -> tuple:
    """``n_words, n_base, first_word, last_word, base_labels, labels, score`` of a text."""
    count, starts, base, labels, score = 0, [], set(), set(), 0.0
    carried: list[bytes] = []
    for block in word_blocks(text):
        fresh = words_of(block)
        words = carried + fresh
        before = count - len(carried)
        count += len(fresh)
        present = VOCABULARY.intersection(words)
        offered = index.offered(present)
        phrases = [(p, label) for p, label in _BASE if present.issuperset(p)]
        if offered or phrases:
            places: dict[bytes, list[int]] = {}
            for at, word in enumerate(words):
                if word in present:
                    places.setdefault(word, []).append(at)
            for phrase, label in phrases:
                for at in places[phrase[0]]:
                    # What ends among the carried words was found with the block before.
                    if at + len(phrase) > len(carried) and words[at : at + len(phrase)] == phrase:
                        starts.append(before + at)
                        base.add(label)
            standing = {n: found for n in offered if (found := index.stands(n, words, places))}
            for label, share in index.matches(words, standing):
                labels.add(label)
                score = max(score, share)
        carried = words[-CARRY:]
    first, last = (min(starts), max(starts)) if starts else (None, None)
    score = 1.0 if base else score
    return count, len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), score


def _texts(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def document_frequencies(docs: DataFrame, text: str = "text") -> dict[bytes, int]:
    """How many documents have each word of the key phrases (a fixed, short list); ``b""`` counts all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                held: set[bytes] = {b""}
                for block in word_blocks((value.as_py() or "").encode()):
                    held |= VOCABULARY.intersection(words_of(block))
                seen.update(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
            ["word", "docs"],
        )

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "word string, docs long")
    rows = counted.groupBy("word").agg(F.sum("docs").alias("docs")).collect()  # one row per word of the key phrases
    return {r["word"].encode(): r["docs"] for r in rows}


def licenses(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Words, base places and labels of every document."""
    seen = document_frequencies(docs, text)
    every = seen.get(b"", 0)
    rarity = {w: math.log((every + 1) / (seen.get(w, 0) + 1)) for w in VOCABULARY}
    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double"
    )
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
    names = [c.split()[0] for c in schema.split(", ")]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rarity)
        for batch in batches:
            found = [scan((t.as_py() or "").encode(), index) for t in batch.column(1)]
            columns = [pa.array([f[i] for f in found], type=kinds[i + 1]) for i in range(7)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return _texts(docs, id, text).mapInArrow(look, schema)
