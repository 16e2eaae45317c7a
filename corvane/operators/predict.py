"""Predictions and token vectors from user models, one model per task."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, types as T

from corvane.operators.tokens import map_texts


WINDOW = 4096  # rows whose texts are sorted by length together


def by_length(lengths: Sequence[int], batch_size: int, token_budget: int | None) -> Iterator[list[int]]:
    """Places of the texts of every batch.

    Without a budget batches are texts in a row. With one, texts are taken from long
    to short, as many as fit when all are padded to the longest; one that is longer
    than the budget by itself is a batch of its own.
    """
    places = list(range(len(lengths)))
    if token_budget is None:
        yield from (places[at : at + batch_size] for at in range(0, len(places), batch_size))
        return
    places.sort(key=lambda i: -lengths[i])
    at = 0
    while at < len(places):
        fit = token_budget // max(1, lengths[places[at]])
        end = at + max(1, min(batch_size, fit))
        yield places[at:end]
        at = end


def count_words(text: str) -> int:
    return len(text.split())


def _add_column(
    df: DataFrame,
    make: Callable[[], Callable[[Sequence[str | None]], Sequence]],
    source: str,
    name: str,
    kind: T.DataType,
    batch_size: int,
    token_budget: int | None,
    length: Callable[[str], int],
    profile: ResourceProfile | None,
) -> DataFrame:
    def make_fn():
        model = make()

        def fn(texts: list[str | None]) -> list[list]:
            given = [i for i, t in enumerate(texts) if t is not None]
            lengths = [length(texts[i]) for i in given] if token_budget is not None else given
            made: list = [None] * len(texts)
            for batch in by_length(lengths, batch_size, token_budget):
                places = [given[i] for i in batch]
                for place, value in zip(places, model([texts[i] for i in places]), strict=True):
                    made[place] = value
            return [made]

        return fn

    window = batch_size if token_budget is None else max(WINDOW, batch_size)
    return map_texts(df, make_fn, source, [T.StructField(name, kind)], window, profile=profile)


def predict(
    df: DataFrame,
    make_predict_fn: Callable[[], Callable[[Sequence[str]], Sequence[str]]],
    prompt: str = "prompt",
    batch_size: int = 16,
    token_budget: int | None = None,
    length: Callable[[str], int] = count_words,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Add ``prediction`` for every prompt; the model sees at most ``batch_size`` prompts at once.

    With ``token_budget`` it sees prompts of about one length together: the rows of
    a window are sorted by ``length``, and a batch padded to its longest prompt has at
    most so many tokens. Predictions are the same and rows stay in their order.
    ``profile`` asks for executors of a kind (with a GPU, say) for this stage alone.
    A NULL prompt has a NULL prediction and is not shown to the model.
    """
    kind = T.StringType()
    return _add_column(df, make_predict_fn, prompt, "prediction", kind, batch_size, token_budget, length, profile)


def embed_tokens(
    df: DataFrame,
    make_encoder: Callable[[], Callable[[Sequence[str]], Sequence]],
    text: str,
    out: str,
    batch_size: int = 16,
    token_budget: int | None = None,
    length: Callable[[str], int] = count_words,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Add one vector per token of a text, for ``greedy_match``; NULL for a NULL text. Batches as in ``predict``."""
    kind = T.ArrayType(T.ArrayType(T.FloatType()))
    return _add_column(df, make_encoder, text, out, kind, batch_size, token_budget, length, profile)
