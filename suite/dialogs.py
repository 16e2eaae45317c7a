"""Conversations to messages, prompts and transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions.records import render_messages as render
from corvane.operators.conversations import (
    chat_prompts,
    context_budget as budget,
    export_transcript,
    history_prompts,
    history_segments as segments,
    to_messages,
    turn_pairs as pair_turns,
)
from corvane.plans.converse import converse as answer_turns
from suite.inputs import COMMANDS_SQL, PAIRS_SQL, WORDS, WS, commands, load
from suite.registry import query


@query(
    f"""SELECT conv_id, 0::BIGINT AS part, COUNT(*) AS turns,
      trim(string_agg('### ' || upper(role[1]) || lower(role[2:]) || E':\\n' || text, E'\\n\\n' ORDER BY turn), {WS}) AS text
    FROM conversations GROUP BY ALL"""
)
def messages(spark, sf):
    rows = to_messages(load(spark, sf, "conversations"))
    return rows.select(
        "conv_id",
        "part",
        F.size("messages").cast("long").alias("turns"),
        render(F.col("messages")).alias("text"),
    )


@query(f'WITH {PAIRS_SQL} SELECT conv_id, turn, prompt AS "user", reference AS assistant FROM pairs')
def turn_pairs(spark, sf):
    return pair_turns(load(spark, sf, "conversations"))


HISTORY_SQL = (
    PAIRS_SQL
    + """,
numbered AS (
  SELECT *, COUNT(a) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM users
),
history AS (
  SELECT n.conv_id, n.turn,
    string_agg(E'### Instruction:\\n' || p.u || E'\\n\\n### Response:\\n' || p.a || E'\\n\\n', '' ORDER BY p.turn) AS h
  FROM numbered n JOIN numbered p
    ON p.conv_id = n.conv_id AND p.a IS NOT NULL AND p.turn < n.turn AND p.before >= n.before - 5
  GROUP BY ALL
),
prompts AS (
  SELECT u.conv_id, u.turn, coalesce(h, '') || E'### Instruction:\\n' || u || E'\\n\\n### Response:\\n' AS prompt
  FROM users u LEFT JOIN history USING (conv_id, turn)
)"""
)


@query(f"WITH {HISTORY_SQL} SELECT conv_id, turn, prompt FROM prompts")
def history_prompt(spark, sf):
    return history_prompts(load(spark, sf, "conversations"))


CHAT_SQL = (
    PAIRS_SQL
    + f""",
chat_history AS (
  SELECT conv_id, turn, string_agg(CASE WHEN a IS NOT NULL THEN 'User: ' || u || E'\\nAssistant: ' || a || E'\\n\\n' END, '')
    OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h, u
  FROM users
),
chat AS (
  SELECT conv_id, turn, E'System: Answer briefly.\\n\\n' || coalesce(h, '') || 'User: ' || u || E'\\nAssistant:' AS prompt
  FROM chat_history
),
counted AS (SELECT *, CAST(len(regexp_extract_all(prompt, {WORDS})) AS BIGINT) AS prompt_tokens FROM chat)"""
)
SYSTEM = "Answer briefly."


@query(
    f"WITH {CHAT_SQL} SELECT conv_id, turn, prompt_tokens, prompt FROM counted"
)
def chat_prompt(spark, sf):
    return chat_prompts(load(spark, sf, "conversations"), SYSTEM)


@query(
    f"""WITH {PAIRS_SQL}, t AS (SELECT conv_id, turn, 'User: ' || u || E'\\nAssistant:' AS prompt FROM users)
    SELECT conv_id, turn, CAST(len(regexp_extract_all(prompt, {WORDS})) AS BIGINT) AS prompt_tokens, prompt FROM t"""
)
def chat_prompt_alone(spark, sf):
    return chat_prompts(load(spark, sf, "conversations"), context=False)


@query(
    f"""WITH {CHAT_SQL} SELECT conv_id, turn, prompt_tokens, 400 - prompt_tokens AS available,
      CASE WHEN prompt_tokens <= 280.0 THEN 'ok' WHEN 400 - prompt_tokens < 60 THEN 'rejected'
        WHEN 400 - prompt_tokens < 100 THEN 'short_reply' ELSE 'long' END AS status FROM counted"""
)
def context_budget(spark, sf):
    prompts = chat_prompts(load(spark, sf, "conversations"), SYSTEM, limit=400, min_left=60)
    return budget(prompts.drop("prompt"), limit=400, min_left=60, want=100)


@query(
    f"""WITH {COMMANDS_SQL}, marked AS (SELECT *,
        SUM(CASE WHEN text = 'clear' THEN 1 ELSE 0 END) OVER w AS segment,
        SUM(CASE WHEN text = 'context' THEN 1 ELSE 0 END) OVER w AS toggles,
        SUM(CASE WHEN text = 'quit' THEN 1 ELSE 0 END) OVER w AS quits
      FROM commands WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, text, CAST(segment AS BIGINT) AS segment, toggles % 2 = 0 AS context_on FROM marked
    WHERE quits = 0 AND text NOT IN ('', 'clear', 'context', 'save')"""
)
def history_segments(spark, sf):
    # Event numbers run through the whole table: far apart in a session.
    return segments(commands(spark, sf))


@query(
    f"""WITH {PAIRS_SQL} SELECT conv_id, 0::BIGINT AS part,
      E'Conversation Log\\nModel: base-7b\\nDate: 2024-01-01T00:00:00\\n' || repeat('=', 80) || E'\\n\\n' ||
      string_agg('User: ' || prompt || E'\\nAssistant: ' || reference || E'\\n' || repeat('-', 80) || E'\\n', '' ORDER BY turn)
      AS transcript FROM pairs GROUP BY conv_id"""
)
def transcript(spark, sf):
    return export_transcript(load(spark, sf, "conversations"), "base-7b", "2024-01-01T00:00:00")


@query(
    f"""WITH {CHAT_SQL} SELECT conv_id, turn, CAST(length(prompt) AS VARCHAR) AS prediction FROM counted
    WHERE prompt_tokens <= 1948"""
)
def converse(spark, sf):
    def make_predict_fn():
        return lambda prompts: [str(len(p)) for p in prompts]

    out = answer_turns(load(spark, sf, "conversations"), make_predict_fn, SYSTEM)
    return out.select("conv_id", "turn", "prediction")


SESSION_SQL = f"""
said AS (
  SELECT conv_id, turn, role, CASE
      WHEN role = 'user' AND (conv_id * 7 + turn) % 11 = 4 THEN ' Clear'
      WHEN role = 'user' AND (conv_id * 5 + turn) % 7 = 2 THEN 'context'
      WHEN role = 'user' AND (conv_id * 3 + turn) % 29 = 6 THEN 'QUIT '
      WHEN role = 'assistant' AND (conv_id + turn) % 13 = 1 THEN 'clear' ELSE text END AS text
  FROM conversations
),
turns AS (
  SELECT conv_id, turn, role, trim(text, {WS}) AS u, lead(role) OVER w AS next_role, trim(lead(text) OVER w, {WS}) AS next_text
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
),
marked AS (
  SELECT conv_id, turn, u, CASE WHEN next_role = 'assistant' THEN next_text END AS a, lower(u) AS word,
    SUM(CASE WHEN lower(u) = 'clear' THEN 1 ELSE 0 END) OVER w AS segment,
    SUM(CASE WHEN lower(u) = 'context' THEN 1 ELSE 0 END) OVER w AS toggles,
    SUM(CASE WHEN lower(u) = 'quit' THEN 1 ELSE 0 END) OVER w AS quits
  FROM turns WHERE role = 'user' AND length(u) > 0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
),
told AS (
  SELECT *, string_agg(CASE WHEN a IS NOT NULL THEN 'User: ' || u || E'\\nAssistant: ' || a || E'\\n\\n' END, '')
    OVER (PARTITION BY conv_id, segment ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h
  FROM marked WHERE quits = 0 AND word NOT IN ('clear', 'context')
),
asked AS (
  SELECT conv_id, turn, segment, E'System: Answer briefly.\\n\\n' || CASE WHEN toggles % 2 = 0 THEN coalesce(h, '') ELSE '' END
    || 'User: ' || u || E'\\nAssistant:' AS prompt FROM told
)"""


def session_messages(spark, sf):
    """The conversations with commands among the user's turns, and replies that look like commands."""
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    conv, turn = F.col("conv_id"), F.col("turn")
    text = (
        F.when(user & ((conv * 7 + turn) % 11 == 4), " Clear")
        .when(user & ((conv * 5 + turn) % 7 == 2), "context")
        .when(user & ((conv * 3 + turn) % 29 == 6), "QUIT ")
        .when(reply & ((conv + turn) % 13 == 1), "clear")
        .otherwise(F.col("text"))
    )
    return load(spark, sf, "conversations").withColumn("text", text)


@query(
    f"""WITH {SESSION_SQL} SELECT conv_id, turn, CAST(segment AS BIGINT) AS segment, reverse(prompt) AS prediction FROM asked
    WHERE len(regexp_extract_all(prompt, {WORDS})) <= 1948"""
)
def converse_commands(spark, sf):
    def make_predict_fn():
        return lambda prompts: [p[::-1] for p in prompts]

    out = answer_turns(session_messages(spark, sf), make_predict_fn, SYSTEM)
    return out.select("conv_id", "turn", "segment", "prediction")
