"""Language identification by interpolated Kneser-Ney character models.

One model per language predicts every letter of a word, and its end, from up to
three letters before it in the word. Counts, continuation counts, discounts and
back-off weights are Spark aggregates over the words of a bounded sample of
labelled documents (whole texts, ``DOCUMENTS`` different ids of a language, chosen by a
digest of the id). The finished models are one sorted array of n-gram hashes with, per
language, a probability and a back-off weight: all n-grams of the sample, whose size
bounds what is broadcast.

Every text is scored whole. As no context crosses a word's edge, a word costs
the same wherever it stands: a task works each different chunk out once, all new
ones of a megabyte of text in one vectorised pass, and adds up. The language
with the lowest cross-entropy per predicted letter wins.

A document is ``rejected`` when even the best language predicts it much worse
than the language's own documents. Documents of the sample that were not counted
calibrate that limit, with more room for short texts.

Defined results. NULL text or no letters: ``und``, score 0, rejected. Without any
labelled row everything is ``und``. Equal entropies: the first language by code
point. Repeated rows get the same result; an empty table gives no rows. Only the
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.llm.common import thinned
from corvane.llm.texts import BLOCK, text_groups, word_blocks
from corvane.session import staged

ORDER = 4
DOCUMENTS = 500  # of a language in the sample
CALIBRATION = 5  # one in so many of them calibrates instead of being counted
ALPHABET = 1 << 10  # letters among which an unseen one is drawn evenly
SHARPNESS = 12.0  # of the score: natural units of entropy per letter
ROOM = 1.5  # entropy above a language's mean that is never rejected; a mixture of known languages has less
KNOWN = 120_000  # chunks that a task holds

LETTERS = regex.compile(r"\p{L}+")
PRIMES = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64
)


def _hashes(codes: np.ndarray) -> list[np.ndarray]:
    """For 1 to ORDER: the hash of so many characters up to each place."""
    terms = [(codes.astype(np.uint64) + np.uint64(1)) * p for p in PRIMES]
    found, total = [], np.zeros(len(codes), dtype=np.uint64)
    for back in range(ORDER):
        shifted = np.zeros_like(total)
        shifted[back:] = terms[back][: len(codes) - back]
        total = total + shifted
        found.append(total ^ (total >> np.uint64(29)))
    return found


def gram_hash(gram: str) -> int:
    codes = np.frombuffer(gram.encode("utf-32-le"), dtype=np.uint32)
    return int(_hashes(codes)[len(gram) - 1][-1])


@dataclass
class Models:
    """All languages' models over one sorted array of n-gram hashes."""

    languages: list[str]
    hashes: np.ndarray  # sorted
    terms: np.ndarray  # n-gram, language: discounted probability; a last row of zeros for unseen ones
    weights: np.ndarray  # n-gram, language: back-off weight as a context; a last row of ones
    empty: np.ndarray  # back-off weight of the empty context
    mean: np.ndarray | None = None  # entropy of a language's own documents
    spread: np.ndarray | None = None  # largest excess over it, by the root of the text's letters

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, at, len(self.hashes)) if len(self.hashes) else at

    def costs(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Cost in natural units per chunk and language, and the predicted letters of every chunk."""
        runs, owner = [], []
        for i, chunk in enumerate(chunks):
            found = LETTERS.findall(chunk.decode().lower())
            runs += found
            owner += [i] * len(found)
        cost = np.zeros((len(chunks), len(self.languages)), dtype=np.float32)
        letters = np.zeros(len(chunks), dtype=np.int64)
        if not runs:
            return cost, letters
        codes = np.frombuffer(f" {' '.join(runs)} ".encode("utf-32-le"), dtype=np.uint32)
        edge = codes == 32
        place = np.arange(len(codes))
        last = np.maximum.accumulate(np.where(edge, place, 0))
        behind = place[1:] - last[:-1]  # characters from the edge before each predicted one
        p = np.full((len(codes) - 1, len(self.languages)), 1 / ALPHABET, dtype=np.float32) * self.empty
        context = None
        for k, hashes in enumerate(_hashes(codes), 1):
            at = self.find(hashes)
            use = behind >= k - 1
            now = self.terms[at[1:]] + (p if context is None else self.weights[context[:-1]] * p)
            p = np.where(use[:, None], now, p)
            context = at
        bits = -np.log(p)
        lengths = np.array([len(r) + 1 for r in runs])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        np.add.at(cost, owner, np.add.reduceat(bits, starts, axis=0))
        np.add.at(letters, owner, lengths)
        return cost, letters


class _Chunks(dict):
    """Numbers of chunks; new ones wait to be worked out together."""

    def __init__(self):
        self.waiting: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        self[chunk] = number = len(self)
        self.waiting.append(chunk)
        return number


def entropies(models: Models, groups: Iterator[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per group of texts: cross-entropies by text and language, and predicted letters by text."""
    known, cost, letters = _Chunks(), None, None
    for texts in groups:
        if cost is None or len(known) > KNOWN:
            known = _Chunks()
            cost = np.zeros((0, len(models.languages)), dtype=np.float32)
            letters = np.zeros(0, dtype=np.int64)
        total = np.zeros((len(texts), len(models.languages)))
        length = np.zeros(len(texts), dtype=np.int64)
        numbered = [
            [np.fromiter(map(known.__getitem__, block.split()), dtype=np.int64) for block in word_blocks(t)]
            for t in texts
        ]
        more, longer = models.costs(known.waiting)
        known.waiting.clear()
        cost, letters = np.concatenate([cost, more]), np.concatenate([letters, longer])
        for i, blocks in enumerate(numbered):
            for numbers in blocks:
                total[i] += cost[numbers].sum(axis=0, dtype=np.float64)
                length[i] += letters[numbers].sum()
        yield total / np.maximum(length, 1)[:, None], length


def _sample(docs: DataFrame, learn: Column, per: int) -> DataFrame:
    """``lang, text, part`` of at most ``per`` documents of every language."""
    labelled = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = thinned(labelled.select("doc_id", "lang").distinct(), "doc_id", ["lang"], per)
    ids = few.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per)
    ids = staged(ids, "language-sample")  # so small a table that Spark broadcasts it, and no text is shuffled
    texts = labelled.join(ids, ["doc_id", "lang"]).groupBy("doc_id", "lang", "rank").agg(F.min("text").alias("text"))
    return staged(texts.select("lang", "text", (F.col("rank") % CALIBRATION == 0).alias("calibrates")), "language-texts")


def _counts(sample: DataFrame) -> DataFrame:
    """``lang, gram, n``: n-grams of 1 to ORDER characters that end in a predicted one."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    words = sample.select("lang", words.alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    padded = words.select("lang", "n", F.concat(F.lit(" "), "word", F.lit(" ")).alias("s"))
    ends = padded.select("lang", "n", "s", F.explode(F.sequence(F.lit(2), F.length("s"))).alias("end"))
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.lit(ORDER), F.col("end"))))
    grams = ends.select("lang", "n", "s", "end", sizes.alias("k"))
    gram = F.substr("s", F.col("end") - F.col("k") + 1, F.col("k"))
    return grams.groupBy("lang", gram.alias("gram")).agg(F.sum("n").alias("n"))


def _kneser_ney(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lang, gram, term, n`` of the n-grams and ``lang, context, weight`` of their contexts."""
    extended = counts.filter(F.length("gram") > 1).groupBy("lang", F.substr("gram", F.lit(2)).alias("gram"))
    before = extended.agg(F.count(F.lit(1)).alias("kinds"))
    # A word's beginning has nothing before it: its own count stands, as for the longest n-grams.
    whole = (F.length("gram") == ORDER) | ((F.length("gram") > 1) & F.col("gram").startswith(" "))
    used = counts.join(before, ["lang", "gram"], "left").select(
        "lang", "gram", "n", F.when(whole, F.col("n")).otherwise(F.coalesce("kinds", "n")).alias("c")
    )
    used = used.withColumn("size", F.length("gram"))
    once, twice = F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
    discount = F.coalesce(F.try_divide(once, once + 2 * twice), F.lit(0.5))
    discounts = used.groupBy("lang", "size").agg(F.greatest(discount, F.lit(0.1)).alias("d"))
    used = used.join(discounts, ["lang", "size"]).withColumn("context", F.substr("gram", F.lit(1), F.length("gram") - 1))
    contexts = used.groupBy("lang", "context").agg(
        F.sum("c").alias("total"), (F.first("d") * F.count(F.lit(1)) / F.sum("c")).alias("weight")
    )
    term = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")
    terms = used.join(contexts, ["lang", "context"]).select("lang", "gram", term.alias("term"))
    return terms, contexts.select("lang", "context", "weight")


def fit(docs: DataFrame, learn: Column, documents: int = DOCUMENTS) -> Models:
    """Models of all languages of the documents that ``learn`` admits.

    ``docs`` has ``doc_id, text, lang``. What comes to the driver are all n-grams
    of the sample, which ``documents`` bounds: words of a language soon repeat
    its n-grams, about 10,000 of them here. Runs jobs.
    """
    sample = _sample(docs, learn, documents)
    terms, contexts = _kneser_ney(staged(_counts(sample.filter(~F.col("calibrates"))), "language-grams"))
    contexts = staged(contexts, "language-contexts")
    both = terms.join(
        contexts.withColumnRenamed("context", "gram"), ["lang", "gram"], "left"
    ).select("lang", "gram", "term", "weight").toPandas()
    empty = {r["lang"]: r["weight"] for r in contexts.filter("context = ''").collect()}
    # A word's edge is a context whether or not the edge was kept as an n-gram.
    edges = {r["lang"]: r["weight"] for r in contexts.filter("context = ' '").collect()}
    languages = sorted(empty)
    names = sorted(set(both["gram"]) | {" "})
    keys = np.array([gram_hash(g) for g in names], dtype=np.uint64)
    order = np.argsort(keys)
    row = {names[i]: at for at, i in enumerate(order)}
    column = {lang: i for i, lang in enumerate(languages)}
    models = Models(
        languages,
        keys[order],
        np.zeros((len(names) + 1, len(languages)), dtype=np.float32),
        np.ones((len(names) + 1, len(languages)), dtype=np.float32),
        np.array([empty[x] for x in languages], dtype=np.float32),
    )
    at = (both["gram"].map(row).to_numpy(dtype=np.int64), both["lang"].map(column).to_numpy(dtype=np.int64))
    models.terms[at] = both["term"]
    models.weights[at] = both["weight"].fillna(1.0)
    for lang, weight in edges.items():
        models.weights[row[" "], column[lang]] = weight
    if languages:
        _calibrate(models, sample.filter("calibrates"))
    return models


def _calibrate(models: Models, sample: DataFrame) -> None:
    scored = _scored(sample.withColumn("doc_id", F.lit(0).cast("long")), models, ["lang"])
    own = scored.filter((F.col("lang") == F.col("best")) & (F.col("letters") > 0))
    per = own.groupBy("lang").agg(F.percentile_approx("entropy", 0.5).alias("mean"))
    excess = (F.col("entropy") - F.col("mean")) * F.sqrt("letters")
    rows = own.join(per, "lang").groupBy("lang").agg(F.first("mean").alias("mean"), F.max(excess).alias("spread"))
    found = {r["lang"]: r for r in rows.collect()}  # one row per language
    usual = max([r["mean"] for r in found.values()], default=float("inf"))
    models.mean = np.array([found[x]["mean"] if x in found else usual for x in models.languages])
    models.spread = np.array([found[x]["spread"] if x in found else 0.0 for x in models.languages])


def _scored(docs: DataFrame, models: Models, keep: list[str]) -> DataFrame:
    """``keep`` and ``best, entropy, score, letters, limit`` of every document with its ``text``."""
    sent = docs.sparkSession.sparkContext.broadcast(models)
    columns = [*dict.fromkeys([*keep, "text"])]
    place = columns.index("text")
    picked = docs.select(*columns)
    kinds = dict(picked.dtypes)
    added = "best string, entropy double, score double, letters long, limit double"
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", " + added
    names = [*keep, *[c.split()[0] for c in added.split(", ")]]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent.value
        held: list[tuple[pa.RecordBatch, int]] = []

        def groups() -> Iterator[list[bytes]]:
            for batch in batches:
                for first, texts in text_groups(batch.column(place), BLOCK):
                    held.append((batch, first))
                    yield texts

        for found, length in entropies(models, groups()):
            batch, first = held.pop()
            best = found.argmin(axis=1)
            least = found[np.arange(len(found)), best]
            rest = np.exp(-SHARPNESS * (found - least[:, None])).sum(axis=1)
            none = length == 0
            limit = np.full(len(found), np.inf)
            if models.mean is not None:
                room = np.maximum(ROOM, 1.5 * models.spread[best] / np.sqrt(np.maximum(length, 1)))
                limit = models.mean[best] + room
            out = [c.slice(first, len(found)) for c in batch.columns[: len(keep)]]
            out += [
                pa.array([None if n else models.languages[b] for n, b in zip(none, best)], pa.string()),
                pa.array(least),
                pa.array(np.where(none, 0.0, 1 / rest)),
                pa.array(length),
                pa.array(limit),
            ]
            yield pa.RecordBatch.from_arrays(out, names)

    return picked.mapInArrow(look, schema)


def identify(docs: DataFrame, models: Models, keep: list[str]) -> DataFrame:
    """``keep`` and ``lang_pred, score, entropy, letters, rejected`` of every document with its ``text``."""
    if not models.languages:
        none = F.lit(0.0)
        return docs.select(
            *keep, F.lit("und").alias("lang_pred"), none.alias("score"), none.alias("entropy"),
            F.lit(0).cast("long").alias("letters"), F.lit(True).alias("rejected"),
        )
    rejected = F.col("best").isNull() | (F.col("entropy") > F.col("limit"))
    return _scored(docs, models, keep).select(
        *keep, F.coalesce("best", F.lit("und")).alias("lang_pred"), "score", "entropy", "letters",
        rejected.alias("rejected"),
    )


def identified(docs: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """The documents that are not rejected, all columns as they are, whatever their names."""
    held = [f"_{i}" if c != text else "text" for i, c in enumerate(docs.columns)]
    kept = identify(docs.toDF(*held), models, held).filter(~F.col("rejected"))
    return kept.select(*held).toDF(*docs.columns)
