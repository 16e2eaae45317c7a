"""Conversation state: prompts as messages arrive, in whatever order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corvane.functions import fixed

MESSAGES = "conv_id long, turn long, role string, text string"
OUTPUT = "conv_id long, turn long, kind string, prompt string"
HISTORY = "blocks array<string>, waiting string, next_turn long, alarm long"
MESSAGE = "role string, text string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

WINDOW = 64  # turns that may overtake a message


def _advance(blocks: list[str], waiting: str | None, role: str | None, text: str | None, last: int):
    """New blocks and waiting message, and the prompt (or None), after one message."""
    said = (text or "").strip(fixed.WHITESPACE)
    if role == "assistant":
        if waiting is not None:
            block = f"{fixed.INSTRUCTION_HEAD}{waiting}\n\n{fixed.RESPONSE_HEAD}{said}"
            blocks = [*blocks, block][-last:]
        return blocks, None, None
    if role != "user" or not said:
        return blocks, None, None
    prompt = "\n\n".join([*blocks, f"{fixed.INSTRUCTION_HEAD}{said}", fixed.RESPONSE_HEAD])
    return blocks, said, prompt


class Reorder(StatefulProcessor):
    """Takes the messages of a conversation in order of their turn, as far as that is known.

    The rows of a trigger go to the buffer, from which messages are taken for as
    long as the next turn is there. A gap is given up when a turn arrives that lies
    ``window`` beyond it, or (with ``idle``) when nothing has arrived for so long.
    What arrives for a turn that was given up is ``late``, for one that was taken,
    or is in the buffer, ``repeated``: both are put out, with no prompt.
    """

    def __init__(self, last: int, window: int, first: int, idle: int | None):
        self.last, self.window, self.first, self.idle = last, window, first, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        keep = None if self.idle is None else 24 * self.idle
        self.history = handle.getValueState("history", HISTORY)
        self.buffer = handle.getMapState("buffer", "turn long", MESSAGE)
        # Ranges of given-up turns, kept for as long as it matters to tell a late message from a repeated one.
        self.missed = handle.getMapState("missed", "start long", "end long", ttlDurationMs=keep)

    def _state(self) -> list:
        if not self.history.exists():
            return [[], None, self.first, 0]
        blocks, waiting, turn, alarm = self.history.get()
        return [list(blocks), waiting, turn, alarm]

    def _take(self, key: tuple, state: list, turn: int) -> Iterator[Row]:
        """Take the message of a turn out of the buffer."""
        role, text = self.buffer.getValue((turn,))
        self.buffer.removeKey((turn,))
        state[0], state[1], prompt = _advance(state[0], state[1], role, text, self.last)
        state[2] = turn + 1
        if prompt is not None:
            yield Row(conv_id=key[0], turn=turn, kind="prompt", prompt=prompt)

    def _ready(self, key: tuple, state: list) -> Iterator[Row]:
        while self.buffer.containsKey((state[2],)):
            yield from self._take(key, state, state[2])

    def _go_to(self, key: tuple, state: list, upto: int) -> Iterator[Row]:
        """Take what is held below a turn, and give up the gaps there."""
        for turn in sorted(k[0] for k in self.buffer.keys() if k[0] < upto):
            if turn >= state[2]:  # not taken by now
                self._miss(state, turn)
                yield from self._ready(key, state)
        self._miss(state, upto)
        yield from self._ready(key, state)

    def _miss(self, state: list, upto: int) -> None:
        if state[2] < upto:
            self.missed.updateValue((state[2],), (upto,))
            state[2] = upto

    def _was_missed(self, turn: int) -> bool:
        """Whether a turn was given up; from now on it no longer counts as that."""
        for (start,), (end,) in list(self.missed.iterator()):
            if start <= turn < end:
                self.missed.removeKey((start,))
                for a, b in ((start, turn), (turn + 1, end)):
                    if a < b:
                        self.missed.updateValue((a,), (b,))
                return True
        return False

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = self._state()
        most = state[2]
        for row in rows:
            turn = row.turn
            if turn is None or turn < state[2]:
                late = turn is None or self._was_missed(turn)
                yield Row(conv_id=key[0], turn=turn, kind="late" if late else "repeated", prompt=None)
                continue
            if self.buffer.containsKey((turn,)):
                yield Row(conv_id=key[0], turn=turn, kind="repeated", prompt=None)
                continue
            self.buffer.updateValue((turn,), (row.role, row.text))
            most = max(most, turn)
        # Only now, so that the order of a trigger's rows plays no part.
        yield from self._ready(key, state)
        yield from self._go_to(key, state, most - self.window + 1)
        if self.idle is not None:
            if state[3]:
                self.handle.deleteTimer(state[3])
            state[3] = timerValues.getCurrentProcessingTimeInMs() + self.idle
            self.handle.registerTimer(state[3])
        self.history.update(tuple(state))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self._state()
        held = [k[0] for k in self.buffer.keys()]
        if held:
            yield from self._go_to(key, state, max(held))
        state[3] = 0
        self.history.update(tuple(state))

    def close(self) -> None:
        pass


def stream_messages(
    spark: SparkSession, directory: str, files_per_trigger: int = 100
) -> DataFrame:
    """Messages of Parquet files that arrive in a directory, a bounded number of files per trigger."""
    return (
        spark.readStream.schema(MESSAGES)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(directory)
    )


def stream_history(
    messages: DataFrame,
    last: int = fixed.HISTORY_PAIRS,
    idle: str | None = "1 hour",
    window: int = WINDOW,
    first: int = 0,
) -> DataFrame:
    """``conv_id, turn, kind, prompt``: the prompt of every user turn, with the last answered turns before it.

    Turns count from ``first``. Messages may arrive in any order in which none is
    overtaken by a turn ``window`` or more beyond it; then the prompts (``kind`` is
    ``prompt``) are those of the whole conversations. Every other message is a
    row too: ``late`` if its turn was given up before it came or it has none,
    ``repeated`` if its turn was taken before. A conversation's state is ``last``
    exchanges, one waiting message and a buffer of at most ``window`` messages, to
    which a trigger's rows are added one by one. After ``idle`` without news gaps are
    given up; a run that is to end by itself (``availableNow``) needs ``idle=None``,
    because timers keep a query going, and leaves what waits for a gap in its state.

    Such state needs Spark's RocksDB store, which this sets for the session.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    millis = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    return (
        messages.select("conv_id", "turn", "role", "text")
        .groupBy("conv_id")
        .transformWithState(
            Reorder(last, window, first, millis), OUTPUT, "append", "None" if idle is None else "ProcessingTime"
        )
    )
