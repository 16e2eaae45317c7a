"""Filter audit against a walk of every document through every order."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np

from corvane.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, part string, mask string, digest int"


def failing(text, copied):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
        "E": copied,
    }


def plain(docs, labels):
    """Rows by part, order and step, a document at a time."""
    first = {}
    for doc, text, _ in docs:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    parts = {}
    for doc, text, lang in docs:
        fails = failing(text or "", doc is not None and first[text or ""] < doc)
        parts.setdefault(lang or "", []).append((doc, fails))
    out = {}
    for part, rows in parts.items():
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = list(rows)
            for step, letter in enumerate(order, 1):
                gone = [d for d, f in left if f[letter]]
                redundant = sum(f[letter] for _, f in rows) - len(gone)
                left = [(d, f) for d, f in left if not f[letter]]
                alone = sum(f[letter] and sum(f.values()) == 1 for _, f in rows)
                shapley[letter] += len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, alone, sum(d in good for d in gone), sum(d in toxic for d in gone)]
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                out[part, order, step].append(shapley[letter])
    return out


def run(spark, docs, labels):
    df = spark.createDataFrame([(d, t, lang, "x", "y", 1) for d, t, lang in docs], SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = filter_audit.audit(df, marks).collect()
    assert len(rows) == len({(r["part"], r["filter_order"], r["step"]) for r in rows})
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in rows}


def test_audit_is_the_walk_of_every_document(spark):
    draw = random.Random(3)
    docs = [(0, None, "en"), (1, "", "en"), (2, "", None), (None, "", ""), (None, "same", "de"), (9000, "same", "de"), (None, "same", "de")]
    for i in range(3, 260):
        pool = [f"w{k}" for k in range(draw.choice([3, 400]))] + ["É", "ÜBER"]
        words = draw.choices(pool, k=draw.choice([5, 99, 100, 150]))
        if draw.random() < 0.3:
            words = [w.upper() for w in words]
        if draw.random() < 0.3:
            words.append(draw.choice("#$%&*|"))
        docs.append((i, draw.choice([" ", "\n", "\x0b"]).join(words), draw.choice(["en", "de", "", None])))
    docs += [(300 + i, docs[20 + i % 9][1], "fr") for i in range(40)]
    docs += [docs[30], docs[30], (17, "a text of an id that has another", "en"), (5000, "x " * 4000, "en")]
    labels = [(d, draw.choice([0, 1, None]), draw.choice([0, 1])) for d in range(0, 340, 2)]
    labels += [(4, 1, 0), (4, 0, 1), (None, 1, 1), (99_999, 1, 1)]
    assert run(spark, docs, labels) == plain(docs, labels)


def test_steps_are_the_first_failing_filter():
    masks, orders = np.arange(8), np.array(list(permutations(range(3))))
    steps = filter_audit.removal_steps(masks, orders)
    for mask in range(8):
        for number, order in enumerate(orders):
            want = next((at for at, f in enumerate(order) if mask >> f & 1), 3)
            assert steps[mask, number] == want


def test_empty(spark):
    assert run(spark, [], []) == {}
    assert len(run(spark, [(1, "a", None)], [])) == 600
