import math
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corvane.functions import fixed
from corvane.functions import records as R
from corvane.functions import scoring, text
from corvane.functions.similarity import common_subsequence, greedy_match, rouge_l
from corvane.operators.examples import eval_pairs, nonempty_pairs, render, validate
from corvane.operators.ingest import canonical, ingest, record_from_columns, reject_sample, with_record


def values(spark, items, expr, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("x"))).collect()]


def texts(n=300):
    rnd = random.Random(5)
    signs = "ab Z9_é\t\n  \x1c.,-" + "ßçÑ"
    return [""] + ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_strings_follow_python(spark):
    items = texts()
    assert values(spark, items, text.strip) == [x.strip() for x in items]
    assert values(spark, items, text.word_count) == [len(x.split()) for x in items]
    half = values(spark, items, lambda c: F.to_json(text.halves(c)))
    assert len(half) == len(items)
    for x, (p, r) in zip(items, [(x[: len(x) // 2], x[len(x) // 2 :]) for x in items]):
        assert p + r == x
    got = values(spark, items, lambda c: text.halves(c)["prompt"])
    assert got == [x[: len(x) // 2] for x in items]


def test_title_case(spark):
    items = ["user", "tool_call", "SYSTEM", "a1b2", "", "two words", "é-à"]
    assert values(spark, items, text.title_case) == [x.title() for x in items]


def test_two_decimals_round_as_printed(spark):
    rnd = random.Random(1)
    items = [2.675, 0.005, 1.005, 99.995, 1234.565, 0.0] + [rnd.uniform(0, 100) for _ in range(300)]
    got = values(spark, items, scoring.two_decimals, "double")
    assert [float(x) for x in got] == [float(f"{x:.2f}") for x in items]


def test_clamp(spark):
    items = [float("nan"), None, float("inf"), float("-inf"), -1.0, 101.0, 50.0, 0.0]
    once = values(spark, items, scoring.clamp_score, "double")
    assert once == [0.0, 0.0, 100.0, 100.0, 0.0, 100.0, 50.0, 0.0]
    assert values(spark, once, scoring.clamp_score, "double") == once


def test_perplexity_scores_match_published_table(spark):
    points = [20.0, 50.0, 100.0, 300.0, 598.0]
    v1 = values(spark, points, lambda c: scoring.ppl_score(c, "v1"), "double")
    v2 = values(spark, points, lambda c: scoring.ppl_score(c, "v2"), "double")
    v3 = values(spark, points, scoring.ppl_score, "double")
    assert [round(x, 1) for x in v1] == [39.1, 21.4, 7.7, 0.0, 0.0]
    assert [round(x, 1) for x in v2] == [93.6, 84.6, 71.7, 36.8, 13.6]
    assert [round(x, 1) for x in v3] == [92.3, 81.9, 67.0, 30.1, 9.1]


def test_grades_at_their_bounds(spark):
    got = values(spark, [90.0, 89.99, 85.0, 80.0, 75.0, 70.0, 65.0, 60.0, 59.99], scoring.grade, "double")
    assert [g[:2].strip() for g in got] == ["A+", "A", "A", "B+", "B", "C+", "C", "D", "F"]


def test_recommendations(spark):
    def advice(*row):
        names = list(fixed.ADVICE)
        df = spark.createDataFrame([row], ", ".join(f"{n} double" for n in names))
        return df.select(scoring.recommendations(**{n: F.col(n) for n in names})).first()[0]

    assert advice(80.0, 20.0, 70.0, 50.0) == [fixed.DEFAULT_ADVICE]
    assert advice(80.0, 20.0, float("nan"), None) == [fixed.DEFAULT_ADVICE]
    assert advice(74.9, 25.0, 59.0, 60.0) == [
        fixed.ADVICE["bert_score"][1],
        fixed.ADVICE["rouge_score"][3],
        fixed.ADVICE["consistency"][1],
        fixed.ADVICE["perplexity_score"][3],
    ]


def test_length_match(spark):
    got = values(spark, [0.0, 1.0, 2.0], scoring.length_match, "double")
    assert got[0] == 50.0
    assert got[1] == pytest.approx(100 * math.exp(-abs(math.log(1.001)) / 0.5))
    assert got[2] == pytest.approx(100 * math.exp(-abs(math.log(2.001)) / 0.5))


LINES = [
    '{"instruction": "Do", "input": "x", "output": "y"}',
    '{"instruction": "Do", "input": "", "response": "lost"}',
    '{"instruction": null}',
    '{"prompt": "p", "completion": "c", "extra": 1}',
    '{"input": "i", "output": "o"}',
    '{"messages": [{"role": "tool_call", "content": " a "}, {"content": "b"}, {"role": "user"}]}',
    '{"messages": "no list", "text": "t"}',
    '{"conversation": ["a", "b"]}',
    '{"text": "plain"}',
    '{"text": "  \\n "}',
    '{"question": "q", "answer": "a"}',
    '{"a": 1, "b": {"c": true}, "d": null}',
    '{"only": "one"}',
    '{"text": "first", "text": "last"}',
    '{"text": "cut',
    '[{"text": "list"}]',
    '{"text": "x"} trailing',
    '{"text": "x"},{"text": "y"}',
    "{'text': 'quotes'}",
    "5",
    "",
]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(list(enumerate(LINES)), "i int, line string")


def test_ingest_keeps_and_rejects(lines):
    taken = ingest(lines)
    good = {r["i"] for r in taken.good.collect()}
    assert good == {0, 1, 2, 3, 4, 5, 6, 8, 9, 13}
    reasons = {r["i"]: r["reason"] for r in taken.rejects.collect()}
    assert {i for i, r in reasons.items() if r == "no_known_shape"} == {7, 10, 11, 12}
    assert {i for i, r in reasons.items() if r == "malformed"} == {14, 15, 16, 17, 18, 19, 20}
    counts = taken.counts.first()
    assert (counts["total_rows"], counts["valid_rows"], counts["skipped_rows"]) == (21, 10, 11)
    assert [r["i"] for r in reject_sample(taken.rejects, "i", n=3).collect()] == [7, 10, 11]


def test_ingest_can_demand_rows(spark, lines):
    with pytest.raises(ValueError):
        ingest(lines.filter("i >= 14"), require_rows=True)


def test_render_every_shape(lines):
    rows = with_record(lines).filter("record is not null")
    got = {r["i"]: r["text"] for r in render(rows, "i").collect()}
    assert got[0] == "### Instruction:\nDo\n\n### Input:\nx\n\n### Response:\ny"
    assert got[1] == "### Instruction:\nDo\n"
    assert got[2] == "### Instruction:\nNone\n"
    assert got[3] == "### Prompt:\np\n\n### Response:\nc"
    assert got[4] == "### Input:\ni\n\n### Output:\no"
    assert got[5] == "### Tool_Call:\n a \n\n### Unknown:\nb\n\n### User:"
    assert got[6] == "t"
    assert got[7] == "### Turn 1:\na\n\n### Turn 2:\nb"
    assert got[8] == "plain"
    assert got[10] == "question:q answer:a"
    assert got[11] == 'a:1 b:{"c":true} d:None'
    assert got[13] == "last"
    kept = {r["i"]: r["text"] for r in render(rows, "i", answer_keys=("output", "response")).collect()}
    assert kept[1] == "### Instruction:\nDo\n\n### Response:\nlost"
    valid = {r["i"]: r["overlong"] for r in validate(render(rows, "i"), 1).collect()}
    assert 9 not in valid and valid[0] and not valid[8]


def test_eval_pairs_order_of_shapes(lines):
    rows = with_record(lines).filter("record is not null")
    got = {r["i"]: (r["prompt"], r["reference"]) for r in eval_pairs(rows, "i").collect()}
    assert got[0] == ("x", "y")
    assert got[1] == ("Do", "")
    assert got[3] == ("p", "c")
    assert got[8] == ("pl", "ain")
    assert got[10] == ("q", "a")
    assert got[11] == ("1", '{"c":true}')
    assert got[12] == ("", "one")
    full = {r["i"]: r["prompt"] for r in eval_pairs(rows, "i", prefer_instruction=True).collect()}
    assert full[0] == "Do\nx"
    kept = {r["i"] for r in nonempty_pairs(eval_pairs(rows, "i")).collect()}
    assert 1 not in kept and 12 not in kept and 2 not in kept and 9 in kept


def test_canonical_and_back(lines):
    typed = canonical(ingest(lines).good)
    assert typed.columns == ["i", *fixed.CANONICAL_KEYS]
    row = typed.filter("i = 5").first()
    assert [m["role"] for m in row["messages"]] == ["tool_call", None, "user"]
    again = record_from_columns(typed, "i")
    text_of = {r["i"]: r["text"] for r in render(again, "i").collect()}
    assert text_of[0].startswith("### Instruction:\nDo") and text_of[8] == "plain"
    shape = again.select("i", R.classify_shape(F.col("record")).alias("s"))
    assert {r["i"]: r["s"] for r in shape.collect()}[5] == "messages"


def test_prompt_helpers(spark):
    df = spark.createDataFrame([("hi", " ok \n")], "m string, a string")
    prompt = text.wrap_prompt(F.col("m"))
    row = df.select(prompt.alias("p"), text.extract_response(F.concat(prompt, "a"), prompt).alias("r")).first()
    assert row["p"] == "### Instruction:\nhi\n\n### Response:\n" and row["r"] == "ok"


def plain_lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


words = st.lists(st.sampled_from("abcde"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(words, words)
def test_common_subsequence_equals_plain_table(a, b):
    assert common_subsequence(a, b) == plain_lcs(a, b) == common_subsequence(b, a)


def test_rouge(spark):
    rows = [
        ("The cat sat.", "the CAT sat"),
        ("a b", "c d"),
        ("", "x"),
        ("日本", "日本"),
        ("a b c d", "a x c"),
        (None, "x"),
    ]
    df = spark.createDataFrame(rows, "p string, r string")
    got = [r[0] for r in df.select(rouge_l(F.col("p"), F.col("r"))).collect()]
    assert got == pytest.approx([1.0, 0.0, 0.0, 0.0, 4 / 7, 0.0])


def test_greedy_match(spark):
    rows = [
        ([[1.0, 0.0], [0.0, 2.0]], [[3.0, 0.0], [0.0, 1.0]]),
        ([[1.0, 0.0]], [[1.0, 0.0], [0.0, 1.0]]),
        ([], [[1.0, 0.0]]),
        ([[0.0, 0.0]], [[1.0, 0.0]]),
    ]
    df = spark.createDataFrame(rows, "a array<array<double>>, b array<array<double>>")
    got = [tuple(r[0]) for r in df.select(greedy_match(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx((1, 1, 1))
    assert got[1] == pytest.approx((1, 0.5, 2 / 3))
    assert got[2] == got[3] == (0.0, 0.0, 0.0)
