"""SimHash groups against all pairs of a small table."""

import random
import re

import pytest
import xxhash

from corvane.llm import simhash
from corvane.llm.components import components
from corvane.llm.texts import word_blocks

SCHEMA = "doc_id long, text string, fp string, b string"


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (doc, _), g in zip(rows, group):
        if doc is not None:
            least[g] = min(doc, least.get(g, doc))
    return sorted((doc, f"{p:016x}", least.get(g)) for (doc, _), p, g in zip(rows, prints, group) if doc is not None)


def texts():
    draw = random.Random(5)
    vocabulary = ["".join(draw.choices("abcdeéÉXY", k=draw.randint(1, 6))) for _ in range(300)]
    base = [draw.choices(vocabulary, k=draw.choice([0, 1, 2, 3, 5, 40, 400, 3000])) for _ in range(60)]
    rows = [" ".join(words) for words in base]
    for words in base:  # near copies
        for _ in range(4):
            near = list(words)
            for _ in range(draw.randint(0, 3)):
                if near:
                    near[draw.randrange(len(near))] = draw.choice(vocabulary)
            rows.append(draw.choice([" ", "\n", "\t \r\x0b\x0c"]).join(near))
    rows += [None, "", " \n ", "a b c d", "A b C", "a B c", "x\x1cy z w", rows[5], rows[5]]
    return list(enumerate(rows))


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 1, 0])
def test_groups_match_all_pairs(spark, bucket):
    rows = texts()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    got = sorted(tuple(r) for r in simhash.grouped(df, bucket=bucket).collect())
    assert got == plain_groups(rows)


def test_blocks_do_not_matter(monkeypatch):
    for size in (1, 7, 50):
        monkeypatch.setattr(simhash, "word_blocks", lambda t, size=size: word_blocks(t, size))
        assert all(simhash.fingerprint(t) == plain_fingerprint(t) for _, t in texts()[:90])


@pytest.mark.parametrize("bucket", [64, 2])
def test_links_reach_every_close_pair(spark, bucket):
    draw = random.Random(9)
    seeds = [draw.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1, 1 << 63]
    values = set()
    for s in seeds:
        for _ in range(25):
            v = s
            for _ in range(draw.randint(0, 5)):
                v ^= 1 << draw.randrange(64)
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), bucket)
    found = {(r["a"], r["b"]) for r in edges.collect()}
    close = {
        (a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2
    }
    assert {tuple(sorted(e)) for e in found} <= close
    if bucket == 64:
        assert found == close
    roots = {}
    for a, b in close:
        roots.setdefault(a, a), roots.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in close:
            least = min(roots[a], roots[b])
            changed |= roots[a] != least or roots[b] != least
            roots[a] = roots[b] = least
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {n: r for n, r in roots.items() if n != r}


def test_long_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 500)] + [(5, 5)]
    got = components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 500)}


def test_empty_and_nameless(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.grouped(empty).count() == 0
    assert simhash.deduplicated(empty).columns == empty.columns
    rows = [(None, "one two three", "", ""), (None, "one two three", "", ""), (4, "one two three", "", "")]
    got = simhash.grouped(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component_id"] for r in got} == {4} and len(got) == 3


def test_one_of_each_group_stays(spark):
    rows = texts()
    rows += [rows[7], rows[7]]  # repeated rows
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({g for _, _, g in plain_groups(rows)})


def test_documents_without_an_id(spark):
    """They go where a component has an id, and one of them stays where none has."""
    rows = [(None, "one two three four"), (None, "one two three four"), (4, "one two three four"), (None, "quite another text here")]
    rows += [(None, "quite another text here"), (None, "QUITE another text here"), (None, None), (None, ""), (9, "a last one by itself")]
    df = spark.createDataFrame([(i, t, "_key", "y") for i, t in rows], SCHEMA).withColumnRenamed("fp", "_key")
    kept = simhash.deduplicated(df).collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "").lower()) for r in kept) == [
        (0, ""), (0, "quite another text here"), (4, "one two three four"), (9, "a last one by itself")
    ]
