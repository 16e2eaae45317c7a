"""URL verdicts from allow and block rules, looked up in Bloom filter cascades.

A rule is a host and a path prefix (``example.com/de/``); it fits the host and
all its subdomains where the path starts with the prefix, and the longest
fitting rule decides. A url therefore fits a rule exactly when the rule is one
of the url's keys: a suffix of its host's labels, followed by as many leading
characters of its path as some rule has. The keys of all urls are the complete
universe against which a cascade is built:

* level 1 is a Bloom filter of the listed keys;
* level 2 is one of the universe's keys that level 1 takes for listed by mistake;
* level 3 is one of the listed keys that level 2 contains, and so on by turns,
  until a level makes no mistake.

The first level that does not contain a key tells whether it is listed. That
is exact for every key of the universe, so no url is joined with the list. The
size of a cascade depends on the list and on the logarithm of the universe, not
on the corpus; it is checked, and a list beyond ``MAX_BITS`` goes by a join.

Defined results. A NULL url or one without ``://`` has an empty host and path
and fits no rule. A url no rule fits gets ``default``. A rule listed both ways
blocks. Equal lengths: the key that is larger by code point. Repeated rows are
judged alike; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corvane.llm.common import ascii_lower
from corvane.session import staged

MAX_BITS = 1 << 21  # of one cascade, 256 KB inside the plan
WORD = 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a url; empty where there is no ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(text, parts, 1)), F.regexp_extract(text, parts, 2)


def url_keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """All keys by which a rule of so many host labels, with a path of such a length, could list a url."""
    own = F.size(F.split(host, r"\."))
    suffixes = F.array_compact(F.array(*[F.when(own >= n, F.substring_index(host, ".", -n)) for n in labels]))
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path)),
        lambda n: F.substr(path, F.lit(1), n),
    )
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def _positions(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(bits)) for i in range(hashes)]


class BloomLevel:
    """One Bloom filter: built by an aggregate, tested inside an expression."""

    def __init__(self, keys: DataFrame, count: int, rate: float, number: int):
        self.number = number
        self.hashes = max(1, round(math.log2(1 / rate)))
        need = math.ceil(count * math.log2(1 / rate) / math.log(2))
        self.bits = WORD * max(1, math.ceil(need / WORD))
        self.words: list[int] = []
        if self.bits <= MAX_BITS:
            at = F.explode(F.array(*_positions(F.col("key"), number, self.hashes, self.bits)))
            set_bits = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / WORD).alias("word"))
            filled = set_bits.agg(F.bit_or(F.expr("shiftleft(1L, int(at % 64))")).alias("bits"))
            self.words = [0] * (self.bits // WORD)
            for row in filled.collect():  # at most MAX_BITS / 64 rows
                self.words[row["word"]] = row["bits"]

    def contains(self, key: Column) -> Column:
        table = F.lit(self.words)

        def is_set(at: Column) -> Column:
            word = F.element_at(table, (F.floor(at / WORD) + 1).cast("int"))
            return F.getbit(word, (at % WORD).cast("int")) == 1

        tests = map(is_set, _positions(key, self.number, self.hashes, self.bits))
        return reduce(lambda a, b: a & b, tests)


class Cascade:
    """Exact membership of a list in a universe of keys, by Bloom filters in turn."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        listed = listed.select("key").distinct()
        members, others = listed.count(), universe.count()
        self.levels: list[BloomLevel] = []
        self.exact = True
        inside, outside = listed, universe.join(listed, "key", "left_anti")
        # The classical choice: level 1 leaves about as many mistakes as half of the list.
        rate = min(0.5, max(members, 1) / max(others, 1) / math.sqrt(2))
        size = members
        while size:
            level = BloomLevel(inside, size, rate, len(self.levels))
            self.levels.append(level)
            if sum(x.bits for x in self.levels) > MAX_BITS:
                self.exact = False
                return
            wrong = staged(outside.filter(level.contains(F.col("key"))), "cascade")
            inside, outside, rate = wrong, inside, 0.5
            size = wrong.count()

    def contains(self, key: Column) -> Column:
        """True for the listed keys, false for all others of the universe."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels) - 1, -1, -1):
            verdict = F.when(~self.levels[depth].contains(key), F.lit(depth % 2 == 1)).otherwise(verdict)
        return verdict


def judge(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """Add ``host, path, rule, verdict`` to every row.

    ``rules`` has ``key`` (host and path prefix) and ``verdict`` (``allow`` or
    ``block``). The pages' columns come back as one struct ``page``.
    """
    host, path = host_and_path(F.col(url))
    parsed = pages.select(F.struct(*pages.columns).alias("page"), host.alias("host"), path.alias("path"))
    prefix = F.length("key") - F.instr("key", "/") + 1
    lengths = [r[0] for r in rules.select(prefix.alias("n")).distinct().orderBy("n").collect()]
    labels = F.size(F.split(F.substring_index("key", "/", 1), r"\."))
    labels = [r[0] for r in rules.select(labels.alias("n")).distinct().orderBy("n").collect()]
    keys = url_keys(F.col("host"), F.col("path"), labels, lengths)
    keyed = parsed.withColumn("keys", keys)
    universe = staged(
        parsed.select("host", "path")
        .withColumn("keys", keys)
        .select(F.explode("keys").alias("key"))
        .distinct(),
        "url-keys",
    )
    lists = {v: rules.filter(F.col("verdict") == v) for v in ("block", "allow")}
    cascades = {v: Cascade(rows, universe) for v, rows in lists.items()}
    if not all(c.exact for c in cascades.values()):
        return _judge_by_join(keyed, rules, default)

    def found(verdict: str) -> Column:
        fitting = F.filter(F.col("keys"), cascades[verdict].contains)
        ranked = F.array_max(F.transform(fitting, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))
        return F.struct(ranked["n"].alias("n"), ranked["k"].alias("k"), F.lit(verdict).alias("verdict"))

    best = F.array_max(
        F.filter(F.array(found("allow"), found("block")), lambda x: x["k"].isNotNull())
    )
    return keyed.withColumn("best", best).select(
        "page",
        "host",
        "path",
        F.col("best.k").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )


def _judge_by_join(keyed: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same verdicts for a list too large for a cascade: distinct addresses meet the list by key."""
    one = rules.groupBy("key").agg(F.max("verdict").alias("verdict"))
    best = F.max(F.struct(F.length("key"), "key", "verdict")).alias("best")
    found = (
        keyed.select("host", "path", "keys")
        .distinct()
        .select("host", "path", F.explode("keys").alias("key"))
        .join(one, "key")
        .groupBy("host", "path")
        .agg(best)
    )
    return keyed.join(found, ["host", "path"], "left").select(
        "page",
        "host",
        "path",
        F.col("best.key").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
