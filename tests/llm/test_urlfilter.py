"""URL verdicts against rules tried one by one; cascades against plain sets."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.llm import urlfilter

SCHEMA = "page_id long, url string, host string, verdict string, rule string"
RULES = [
    ("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"),
    ("a.org/", "block"), ("b.a.org/x", "allow"), ("org/fr/", "block"),
]


def plain(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in found[1]) if found else ""
    path = found[2] if found else ""
    fits = []
    for key, verdict in RULES:
        own, slash, prefix = key.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith(slash + prefix):
            fits.append((len(key), key, verdict))
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def urls():
    draw = random.Random(8)
    hosts = ["net", "NET", "x.net", "xnet", "example.net", "www.Example.net", "example.com", "m.example.com"]
    hosts += ["org", "fr.org", "a.org", "b.a.org", "c.b.a.org", "..a.org", "a.org.", "", "É.net", "ıI.net", "net:80"]
    paths = ["", "/", "/en/", "/en", "/de/1", "/fr/", "/fr/x?y=/en/", "#/fr/", "?://x.net/", "/x", "/xy\n/", "//en/"]
    out = [f"{draw.choice(['http', 'x', ''])}://{draw.choice(hosts)}{draw.choice(paths)}" for _ in range(600)]
    return [None, "", "net/", "http:/net/", "a://b://net/", "\nhttp://net/\n", *out]


@pytest.mark.parametrize("bits", [urlfilter.MAX_BITS, 0])
def test_every_url_gets_its_longest_rule(spark, monkeypatch, bits):
    monkeypatch.setattr(urlfilter, "MAX_BITS", bits)
    rows = list(enumerate(urls())) * 2  # every row repeated
    df = spark.createDataFrame([(i, u, "h", "v", "r") for i, u in rows], SCHEMA)
    rules = spark.createDataFrame(RULES, "key string, verdict string")
    found = urlfilter.judge(df, rules).collect()
    got = sorted((r["page"]["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in found)
    want = [(i, *plain(u)) for i, u in rows]
    assert got == sorted((i, h, p, r or "", v) for i, h, p, r, v in want)


def test_cascade_is_exact_over_its_universe(spark):
    every = spark.range(6000).selectExpr("concat('k', id) AS key")
    listed = every.filter("xxhash64(key) % 7 = 0")
    cascade = urlfilter.Cascade(listed, every)
    assert cascade.exact and len(cascade.levels) > 1
    said = every.filter(cascade.contains(every["key"])).select("key")
    assert said.exceptAll(listed).isEmpty() and listed.exceptAll(said).isEmpty()
    none = urlfilter.Cascade(every.limit(0), every)
    assert every.filter(none.contains(every["key"])).isEmpty()


def test_empty(spark):
    rules = spark.createDataFrame(RULES, "key string, verdict string")
    assert urlfilter.judge(spark.createDataFrame([], SCHEMA), rules).collect() == []


def test_hosts_of_many_labels_have_few_keys(spark):
    """A host is cut at the label counts that rules have, whatever its length."""
    hosts = ["a." * 20_000 + "b.a.org", "a." * 20_000 + "com", "." * 5000 + "net"]
    df = spark.createDataFrame([(i, f"http://{h}/x", "", "", "") for i, h in enumerate(hosts)], SCHEMA)
    keys = urlfilter.url_keys(F.lit(hosts[0]), F.lit("/x"), [1, 3], [1, 2])
    assert df.select(F.size(keys)).first()[0] == 4
    rules = spark.createDataFrame(RULES, "key string, verdict string")
    found = sorted(urlfilter.judge(df, rules).collect(), key=lambda r: r["page"]["page_id"])
    assert [r["rule"] for r in found] == [plain(f"http://{h}/x")[2] for h in hosts]
