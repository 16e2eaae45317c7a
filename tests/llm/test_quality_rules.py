"""Quality counts against plain Python, and what line rules keep."""

import random
import re

from corvane.llm import quality_rules

SCHEMA = "doc_id long, text string, kept string, words string, doc string, body string"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen: dict = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + d for places in seen.values() if len(places) > 1 for i in places for d in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


PROSE = "The quick brown fox jumps over the lazy dog near a quiet river, and nobody minds it at all today."


def rows():
    draw = random.Random(6)
    out = []
    for _ in range(150):
        pool = draw.choice([["a", "b", "É*", "|"], [f"w{i}" for i in range(400)]])
        gap = [" ", " ", " ", "\n", "\t", "\x0b", "\r\n", "  "]
        out.append("".join(draw.choice(pool) + draw.choice(gap) for _ in range(draw.choice([0, 5, 8, 30, 300]))))
    block = " ".join(f"u{i}" for i in range(12))
    out += [None, "", "\n\n", "x\x1cy z\x85w", block + " " + block, "x " * 3000, PROSE, "\n".join([PROSE] * 2)]
    out += [PROSE + "\nHome | News | About | Contact\nClick here to read more", "WOW!! " * 40, "🙂 é " * 30]
    return list(enumerate(out))


def test_counts(spark):
    data = rows()
    data.append(data[3])
    df = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in data], SCHEMA)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = sorted((r["doc"]["doc_id"], *(r[n] for n in names)) for r in quality_rules.judged(df).collect())
    assert got == sorted((i, *plain(t)) for i, t in data)


def test_lines_that_go_and_documents_that_stay(spark):
    more = "Rain fell on every roof of that old town for days, while children read long books inside."
    cases = {
        1: (f"{PROSE}\n{more}", True),
        2: (f"{PROSE}\nHome | News | About\n{more}\nWe use cookies to help you.\nMenu", True),
        3: ("Th*** is*** all### of%%% it&&& and$$$ more*** of*** the*** same&&& kind### for$$$ twenty%%% words*** or*** so*** here*** now*** then*** ok***", False),
        4: (" ".join(f"LOUD{i}!!" for i in range(30)), False),
        5: ("\n".join(f"a{i} | b{i} | c{i} | d{i} | e{i}" for i in range(9)), False),
        6: ("Short text.", False),
        7: (f"{PROSE}\nAlle Rechte vorbehalten durch den Verlag in Köln, seit 1990.\n{more}\nTOUS DROITS RÉSERVÉS par nous depuis.\nPolítica de privacidad y cookies del sitio.", True),
    }
    df = spark.createDataFrame([(i, t, "", "", "", "") for i, (t, _) in cases.items()], SCHEMA)
    found = {r["doc"]["doc_id"]: r for r in quality_rules.judged(df).collect()}
    assert {i: found[i]["kept"] for i in cases} == {i: k for i, (_, k) in cases.items()}
    assert found[1]["cleaned"] == cases[1][0] and found[2]["cleaned"] == f"{PROSE}\n{more}"
    assert found[7]["cleaned"] == f"{PROSE}\n{more}"
    assert quality_rules.judged(df.limit(0)).collect() == []


def test_no_shuffle_and_no_python(spark):
    df = spark.createDataFrame([(1, PROSE, "", "", "", "")], SCHEMA)
    plan = quality_rules.judged(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
