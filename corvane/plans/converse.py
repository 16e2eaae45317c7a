"""From conversations to answers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from corvane.functions import fixed
from corvane.operators.conversations import chat_prompts, context_budget, session_turns
from corvane.operators.predict import predict


def converse(
    conversations: DataFrame,
    make_predict_fn: Callable[[], Callable[[Sequence[str]], Sequence[str]]],
    system: str | None = None,
    context: bool = True,
    batch_size: int = 16,
    limit: int = fixed.CONTEXT_LIMIT,
) -> DataFrame:
    """Answer every user turn whose prompt leaves room for one.

    Commands act as in a session: ``clear`` begins a new history, ``context``
    turns its use off and on, nothing is answered after a quit, and commands
    themselves are not answered. ``context=False`` leaves all history out.
    """
    turns = session_turns(conversations)
    prompts = chat_prompts(
        turns, system, "context_on" if context else False, limit, by=("conv_id", "segment")
    )
    prompts = context_budget(prompts, limit=limit)
    return predict(prompts.filter(F.col("status") != "rejected"), make_predict_fn, "prompt", batch_size)
