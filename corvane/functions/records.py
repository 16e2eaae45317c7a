"""Rendering of raw records.

A record is a ``MAP<STRING, STRING>`` from key to value (nested values as JSON
text), so "the key is present" and "the value is null" stay different things.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from corvane.functions import fixed
from corvane.functions.text import halves, shown, strip, title_case, truthy

MESSAGES_TYPE = "array<struct<role:string,content:string>>"


def has(record: Column, *keys: str) -> Column:
    """True when every key is present, whatever its value."""
    present = F.map_contains_key(record, keys[0])
    for key in keys[1:]:
        present = present & F.map_contains_key(record, key)
    return present


def is_list(record: Column, key: str) -> Column:
    """True when the value of a key is a list (told by how its JSON text starts)."""
    return F.coalesce(record[key].startswith("["), F.lit(False))


def messages_of(record: Column) -> Column:
    """The ``messages`` list, NULL when the value is not a list."""
    return F.when(is_list(record, "messages"), F.from_json(record["messages"], MESSAGES_TYPE))


def turns_of(record: Column) -> Column:
    """The ``conversation`` list, NULL when the value is not a list."""
    return F.when(
        is_list(record, "conversation"), F.from_json(record["conversation"], "array<string>")
    )


def accepted(record: Column) -> Column:
    """True when permissive ingest keeps the record."""
    return (
        has(record, "prompt", "completion")
        | has(record, "instruction")
        | has(record, "input", "output")
        | has(record, "messages")
        | has(record, "text")
    )


def classify_shape(record: Column) -> Column:
    """Name of the shape that rendering picks; the first that matches wins."""
    return (
        F.when(has(record, "instruction"), "instruction")
        .when(has(record, "prompt", "completion"), "prompt_completion")
        .when(has(record, "input", "output"), "input_output")
        .when(is_list(record, "messages"), "messages")
        .when(is_list(record, "conversation"), "conversation")
        .when(has(record, "text"), "text")
        .otherwise("other")
    )


def render_instruction(instruction: Column, given: Column, answer: Column) -> Column:
    return F.concat(
        F.lit(fixed.INSTRUCTION_HEAD),
        shown(instruction),
        F.lit("\n"),
        F.when(truthy(given), F.concat(F.lit("\n" + fixed.INPUT_HEAD), given, F.lit("\n"))).otherwise(""),
        F.when(truthy(answer), F.concat(F.lit("\n" + fixed.RESPONSE_HEAD), answer)).otherwise(""),
    )


def render_prompt_completion(prompt: Column, completion: Column) -> Column:
    return F.concat(
        F.lit(fixed.PROMPT_HEAD), shown(prompt), F.lit("\n\n" + fixed.RESPONSE_HEAD), shown(completion)
    )


def render_input_output(given: Column, output: Column) -> Column:
    return F.concat(
        F.lit(fixed.INPUT_HEAD), shown(given), F.lit("\n\n" + fixed.OUTPUT_HEAD), shown(output)
    )


def _told(messages: Column) -> Column:
    """Role and content of every message as they read: a content given as null reads ``None``."""
    parts = F.from_json(messages, "array<map<string,string>>")
    content = lambda m: F.when(F.map_contains_key(m, "content"), shown(m["content"]))
    return F.transform(parts, lambda m: F.struct(m["role"].alias("role"), content(m).alias("content")))


def render_messages(messages: Column) -> Column:
    """Blocks headed by the title-cased role, stripped as a whole."""
    blocks = F.transform(
        messages,
        lambda m: F.concat(
            F.lit("### "),
            title_case(F.coalesce(m["role"], F.lit("unknown"))),
            F.lit(":\n"),
            F.coalesce(m["content"], F.lit("")),
        ),
    )
    return strip(F.array_join(blocks, "\n\n"))


def render_conversation(turns: Column) -> Column:
    blocks = F.transform(
        turns,
        lambda turn, i: F.concat(F.lit("### Turn "), (i + 1).cast("string"), F.lit(":\n"), shown(turn)),
    )
    return F.array_join(blocks, "\n\n")


def render_text(text: Column) -> Column:
    return text


def render_fallback(record: Column) -> Column:
    """``key:value`` of every field, in the record's key order."""
    pairs = F.transform(
        F.map_entries(record), lambda e: F.concat(e["key"], F.lit(":"), shown(e["value"]))
    )
    return F.array_join(pairs, " ")


def render_record(record: Column, answer_keys: Sequence[str] = ("output",)) -> Column:
    """Training text of a record of any shape.

    ``answer_keys`` names where an instruction's answer may stand; the first
    non-empty one is used. Add ``"response"`` to keep answers given there.
    """
    answer = F.coalesce(*[F.when(truthy(record[k]), record[k]) for k in answer_keys])
    return (
        F.when(
            has(record, "instruction"),
            render_instruction(record["instruction"], record["input"], answer),
        )
        .when(
            has(record, "prompt", "completion"),
            render_prompt_completion(record["prompt"], record["completion"]),
        )
        .when(has(record, "input", "output"), render_input_output(record["input"], record["output"]))
        .when(is_list(record, "messages"), render_messages(_told(record["messages"])))
        .when(
            is_list(record, "conversation"),
            render_conversation(F.from_json(record["conversation"], "array<string>")),
        )
        .when(has(record, "text"), render_text(record["text"]))
        .otherwise(render_fallback(record))
    )


def eval_pair(record: Column, prefer_instruction: bool = False) -> Column:
    """Struct ``(prompt, reference)`` for evaluation; the first match wins.

    ``input`` + ``output`` comes before ``instruction``, so a record with all
    three loses its instruction unless ``prefer_instruction`` is set.
    """

    def pair(prompt: Column, reference: Column) -> Column:
        return F.struct(prompt.alias("prompt"), reference.alias("reference"))

    instruction = pair(
        F.concat(
            record["instruction"],
            F.when(truthy(record["input"]), F.concat(F.lit("\n"), record["input"])).otherwise(""),
        ),
        F.when(has(record, "output"), record["output"]).otherwise(""),
    )
    values = F.map_values(record)
    first_two = F.when(
        F.size(values) >= 2,
        pair(shown(F.get(values, F.lit(0))), shown(F.get(values, F.lit(1)))),
    ).otherwise(
        pair(F.lit(""), F.when(F.size(values) == 1, shown(F.get(values, F.lit(0)))).otherwise(""))
    )
    choice = F.when(has(record, "prompt", "completion"), pair(record["prompt"], record["completion"]))
    if prefer_instruction:
        choice = choice.when(has(record, "instruction"), instruction)
    return (
        choice.when(has(record, "input", "output"), pair(record["input"], record["output"]))
        .when(has(record, "instruction"), instruction)
        .when(has(record, "question", "answer"), pair(record["question"], record["answer"]))
        .when(has(record, "text"), halves(record["text"]))
        .otherwise(first_two)
    )
