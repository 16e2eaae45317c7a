"""Conversation tables ``(conv_id, turn, role, text)`` to messages and prompts.

``turn`` is the whole-number position in the conversation, unique in it. No
operator puts a whole conversation into one task: see ``ordered``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.functions import fixed
from corvane.functions.text import strip, word_tokens
from corvane.operators.joins import join_same
from corvane.operators.once import once
from corvane.operators.ordered import (
    CHUNK,
    CHUNK_COL,
    Running,
    carry_window,
    chunk_window,
    next_row,
    running,
    sparse_chunks,
    with_chunk,
)

KEY = ("conv_id",)


def to_messages(df: DataFrame, part_turns: int | None = None) -> DataFrame:
    """One row ``(conv_id, part, messages)`` per conversation, ``part`` 0.

    ``part_turns`` cuts conversations into rows of so many turns, in order of
    ``part``, for conversations too long for one row.
    """
    parts = with_chunk(df, "turn", part_turns) if part_turns else df.withColumn(CHUNK_COL, F.lit(0).cast("long"))
    parts = parts.withColumnRenamed(CHUNK_COL, "part")
    entry = F.struct("turn", F.col("role"), F.col("text").alias("content"))
    listed = parts.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(entry)).alias("m"))
    messages = F.transform(
        "m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))
    )
    return listed.select("conv_id", "part", messages.alias("messages"))


def _paired(df: DataFrame, size: int, by: Sequence[str]) -> DataFrame:
    """Non-blank user turns with the answer that directly follows (or NULL), in chunks."""
    if {"user", "assistant"} <= set(df.columns):
        return with_chunk(df, "turn", size).withColumn("_later", F.lit(True))
    rows = next_row(df, by, "turn", ["role", "text"], size)
    user = strip(F.col("text"))
    answer = F.when(F.col("next.role") == "assistant", strip(F.col("next.text")))
    return rows.filter((F.col("role") == "user") & (F.length(user) > 0)).select(
        *by,
        "turn",
        user.alias("user"),
        answer.alias("assistant"),
        CHUNK_COL,
        "_later",
    )


def user_turns(df: DataFrame, size: int = CHUNK) -> DataFrame:
    """``(conv_id, turn, user, assistant)`` of every non-blank user turn, the answer NULL if there is none.

    Prompt operators take these rows as well as the messages themselves.
    """
    return _paired(df, size, KEY).select(*KEY, "turn", "user", "assistant")


def turn_pairs(df: DataFrame, size: int = CHUNK) -> DataFrame:
    """``(conv_id, turn, user, assistant)`` of every answered user turn."""
    return user_turns(df, size).filter(F.col("assistant").isNotNull())


def _instruction(user: Column) -> Column:
    return F.concat(F.lit(fixed.INSTRUCTION_HEAD), user)


def exchange_block(user: Column, assistant: Column) -> Column:
    """An answered turn as it stands in the history of later prompts."""
    return F.concat(_instruction(user), F.lit("\n\n" + fixed.RESPONSE_HEAD), assistant)


def history_prompt(history: Column, user: Column) -> Column:
    """Prompt from an array of earlier blocks and the new message."""
    blocks = F.concat(F.coalesce(history, F.array().cast("array<string>")), F.array(_instruction(user)))
    return F.concat(F.array_join(blocks, "\n\n"), F.lit("\n\n" + fixed.RESPONSE_HEAD))


def _last_of(blocks: Column, n: int) -> Column:
    return F.slice(blocks, F.greatest(F.size(blocks) - n + 1, F.lit(1)), n)


def history_prompts(
    df: DataFrame, last: int = fixed.HISTORY_PAIRS, size: int = CHUNK, by: Sequence[str] = KEY
) -> DataFrame:
    """Prompt of every user turn: the ``last`` answered turns before it, then it.

    ``by`` names what a history belongs to, as ``("conv_id", "segment")`` after
    ``session_turns``.
    """
    rows = _paired(df, size, by).withColumn("answered", F.col("assistant").isNotNull())
    block = F.when(F.col("answered"), exchange_block(F.col("user"), F.col("assistant")))

    # The last answered turns up to and with each answered turn of the chunk.
    among = Window.partitionBy(*by, CHUNK_COL, "answered").orderBy("turn")
    recent = F.collect_list("block").over(among.rowsBetween(-(last - 1), 0))
    rows = rows.withColumn("block", block).withColumn(
        "recent", F.when(F.col("answered"), recent)
    )

    # Carried into later chunks, for conversations that have any.
    ends = rows.filter("_later").groupBy(*by, CHUNK_COL).agg(
        F.max_by("recent", F.when(F.col("answered"), F.col("turn"))).alias("recent")
    )
    order = carry_window(by).rowsBetween(-(last - 1), 0)
    joined = F.flatten(F.collect_list("recent").over(order))
    ends = ends.filter(F.col("recent").isNotNull()).withColumn("upto", _last_of(joined, last))

    local = F.last("recent", ignorenulls=True).over(
        chunk_window(by, "turn").rowsBetween(Window.unboundedPreceding, -1)
    )
    none = F.array().cast("array<string>")
    rows = _with_carry(rows.withColumn("local", local), _later_chunks(df, size, by), ends, "upto", "carried", by)
    history = _last_of(F.concat(F.coalesce("carried", none), F.coalesce("local", none)), last)
    return rows.select(*by, "turn", history_prompt(history, F.col("user")).alias("prompt"))


def _budget_status(tokens: Column, limit: int, warn: float, min_left: int, want: int) -> Column:
    return (
        F.when(tokens <= limit * warn, "ok")
        .when(limit - tokens < min_left, "rejected")
        .when(limit - tokens < want, "short_reply")
        .otherwise("long")
    )


def context_budget(
    df: DataFrame,
    tokens: str = "prompt_tokens",
    limit: int = fixed.CONTEXT_LIMIT,
    warn: float = fixed.CONTEXT_WARN_SHARE,
    min_left: int = fixed.CONTEXT_MIN_LEFT,
    want: int = fixed.REPLY_LENGTH,
) -> DataFrame:
    """Add ``available`` and ``status``: ok, long, short_reply or rejected."""
    status = _budget_status(F.col(tokens), limit, warn, min_left, want)
    return df.withColumn("available", F.lit(limit) - F.col(tokens)).withColumn("status", status)


def _count(text: Column) -> Column:
    return F.size(word_tokens(text))


def chat_prompts(
    df: DataFrame,
    system: str | None = None,
    context: bool | str = True,
    limit: int | None = None,
    warn: float = fixed.CONTEXT_WARN_SHARE,
    min_left: int = fixed.CONTEXT_MIN_LEFT,
    size: int = CHUNK,
    by: Sequence[str] = KEY,
) -> DataFrame:
    """Transcript prompt of every user turn with its whole history.

    ``context`` may name a boolean column: where it is false the prompt has no
    history, though the exchange enters that of later ones. ``by`` names what a
    history belongs to.

    Give ``limit``, ``warn`` and ``min_left`` as to ``context_budget`` to leave
    the text of the prompts NULL that it rejects; their ``prompt_tokens`` are
    exact all the same. That bounds the history of the others, which only grows
    (each answered turn costs four tokens at least). Without a limit every row
    has its text, however long.
    """
    by = list(by)
    head = f"System: {system}\n\n" if system else ""
    shown = F.col(context) if isinstance(context, str) else F.lit(context)
    rows = _paired(df, size, by).withColumn("answered", F.col("assistant").isNotNull())
    rows = rows.withColumn("_context", shown)
    own = F.lit(4) + _count(F.col("user"))  # "User:" and "Assistant:" are two tokens each
    rows = once(rows, own=own, reply=F.when(F.col("answered"), _count(F.col("assistant"))))
    rows = rows.withColumn("pair", F.coalesce(F.col("own") + F.col("reply"), F.lit(0)))
    tail = F.concat(F.lit("User: "), F.col("user"), F.lit("\nAssistant:"))
    alone = F.col("own") + _count(F.lit(head))

    def fits(tokens: Column) -> Column:
        if limit is None:
            return F.lit(True)
        return _budget_status(tokens, limit, warn, min_left, 0) != "rejected"

    if context is False:
        rows = rows.withColumn("prompt_tokens", alone.cast("long"))
        text = F.when(fits(F.col("prompt_tokens")), F.concat(F.lit(head), tail))
        return rows.select(*by, "turn", "prompt_tokens", text.alias("prompt"))

    asking = _later_chunks(df, size, by)
    # Tokens of earlier exchanges: the chunk's own running sum plus a carry.
    totals = rows.filter("_later").groupBy(*by, CHUNK_COL).agg(F.sum("pair").alias("pair"))
    before = F.sum("pair").over(carry_window(by))
    sums = totals.select(*by, CHUNK_COL, before.alias("tokens"))
    window = chunk_window(by, "turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("pair").over(window), F.lit(0)))
    rows = _with_carry(rows, asking, sums, "tokens", "carried_tokens", by)
    whole = (F.coalesce("carried_tokens", F.lit(0)) + F.col("inside") + alone).cast("long")
    rows = rows.withColumn("whole_tokens", whole).withColumn(
        "prompt_tokens", F.when(F.col("_context"), F.col("whole_tokens")).otherwise(alone.cast("long"))
    )

    # An exchange whose own history does not fit is in no later prompt that fits.
    block = F.concat(
        F.lit("User: "), F.col("user"), F.lit("\nAssistant: "), F.col("assistant"), F.lit("\n\n")
    )
    rows = rows.withColumn("block", F.when(fits(F.col("whole_tokens")) & F.col("answered"), block))
    texts = rows.filter(F.col("_later") & F.col("block").isNotNull()).groupBy(*by, CHUNK_COL).agg(
        F.array_sort(F.collect_list(F.struct("turn", "block"))).alias("blocks")
    )
    text_so_far = F.flatten(F.collect_list("blocks").over(carry_window(by)))
    earlier = texts.select(*by, CHUNK_COL, F.array_join(text_so_far["block"], "").alias("text"))
    told = fits(F.col("whole_tokens")) & F.col("_context")
    rows = rows.withColumn("inside_text", F.when(told, F.array_join(F.collect_list("block").over(window), "")))
    rows = _with_carry(rows, asking, earlier, "text", "carried_text", by)
    history = F.concat(F.coalesce("carried_text", F.lit("")), F.col("inside_text"))
    prompt = F.concat(F.lit(head), F.when(F.col("_context"), history).otherwise(""), tail)
    return rows.select(*by, "turn", "prompt_tokens", F.when(fits(F.col("prompt_tokens")), prompt).alias("prompt"))


def _later_chunks(df: DataFrame, size: int, by: Sequence[str]) -> DataFrame:
    """Chunks after a conversation's first; the scan can use the filter on ``turn``."""
    return with_chunk(df.filter(F.col("turn") >= size), "turn", size).select(*by, CHUNK_COL).distinct()


def _with_carry(
    rows: DataFrame, asking: DataFrame, ends: DataFrame, value: str, out: str, by: Sequence[str]
) -> DataFrame:
    """Give every chunk the value that holds at the end of the chunks before it.

    ``ends`` has one row per chunk that ends with a new value; chunks without
    such a row pass the earlier value on.
    """
    kind = ends.schema[value].dataType
    # A chunk's own end comes after the question what was before it.
    points = asking.select(
        *by, CHUNK_COL, F.lit(0).alias("end"), F.lit(None).cast(kind).alias(value)
    ).unionByName(ends.select(*by, CHUNK_COL, F.lit(1).alias("end"), value))
    order = Window.partitionBy(*by).orderBy(CHUNK_COL, "end")
    carried = (
        points.withColumn(out, F.last(value, ignorenulls=True).over(order))
        .filter(F.col("end") == 0)
        .select(*by, CHUNK_COL, out)
    )
    return join_same(rows, carried, [*by, CHUNK_COL], "left")


def history_segments(
    df: DataFrame,
    key: str = "conv_id",
    order: str = "turn",
    text: str = "text",
    role: str = "role",
    quit_words: tuple[str, ...] = fixed.QUIT_COMMANDS,
    size: int = CHUNK,
) -> DataFrame:
    """Messages with the number of resets before them (``segment``) and whether
    history is in use (``context_on``); commands, blank lines and all that
    follows the first quit are dropped.

    Only a user gives commands: where the rows have a ``role``, those of other
    roles are no commands whatever they say. The order column may be any whole
    number; the rows are stored in chunks of it first.
    """
    said = strip(F.col(text))
    word = F.lower(said)
    user = F.col(role) == "user" if role in df.columns else F.lit(True)
    is_clear, is_toggle = user & (word == fixed.CLEAR_COMMAND), user & (word == fixed.CONTEXT_COMMAND)
    is_quit = user & word.isin(*quit_words)
    marked = running(
        sparse_chunks(df, [key], order, size),
        [key],
        order,
        {
            "segment": Running("sum", is_clear.cast("long")),
            "toggles": Running("sum", is_toggle.cast("long")),
            "quits": Running("sum", is_quit.cast("long")),
        },
    )
    command = is_clear | is_toggle | is_quit | (user & word.isin(*fixed.OTHER_COMMANDS))
    return (
        marked.filter((F.col("quits") == 0) & (F.length(said) > 0) & ~command)
        .withColumn("context_on", F.col("toggles") % 2 == 0)
        .drop("toggles", "quits", CHUNK_COL)
    )


def session_turns(df: DataFrame, size: int = CHUNK) -> DataFrame:
    """User turns of a session with commands: ``conv_id, turn, user, assistant, segment, context_on``.

    Answers are taken from the messages as they stand, so the reply to a command
    is nobody's answer. Prompts of these rows go by ``("conv_id", "segment")``.
    """
    return history_segments(user_turns(df, size), text="user", size=size)


def export_transcript(
    df: DataFrame, model: str, date: str, part_turns: int | None = None
) -> DataFrame:
    """``(conv_id, part, transcript)``: title lines, then one block per exchange.

    A conversation is one part, 0, unless ``part_turns`` asks for parts of so
    many turns; the first of them has the title lines.
    """
    head = f"{fixed.TRANSCRIPT_TITLE}\nModel: {model}\nDate: {date}\n" + "=" * fixed.RULE_WIDTH + "\n\n"
    block = F.concat(
        F.lit("User: "),
        F.col("user"),
        F.lit("\nAssistant: "),
        F.col("assistant"),
        F.lit("\n" + "-" * fixed.RULE_WIDTH + "\n"),
    )
    pairs = _paired(df, part_turns or CHUNK, KEY).filter(F.col("assistant").isNotNull())
    if part_turns is None:
        pairs = pairs.withColumn(CHUNK_COL, F.lit(0).cast("long"))
    bodies = pairs.groupBy(*KEY, CHUNK_COL).agg(
        F.array_sort(F.collect_list(F.struct("turn", block.alias("block")))).alias("blocks")
    )
    title = F.lit(head)
    if part_turns is not None:
        ends = pairs.filter("_later").select(*KEY, CHUNK_COL, F.lit(True).alias("any")).distinct()
        bodies = _with_carry(bodies, _later_chunks(df, part_turns, KEY), ends, "any", "begun", KEY)
        title = F.when(F.col("begun").isNull(), head).otherwise("")
    return bodies.select(
        "conv_id",
        F.col(CHUNK_COL).alias("part"),
        F.concat(title, F.array_join(F.col("blocks")["block"], "")).alias("transcript"),
    )
