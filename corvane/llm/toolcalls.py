"""Chat messages with tool calls: linked, ordered, validated, in canonical JSON.

A message's text is plain, or a JSON object with ``tool_calls`` (a list of
``id``, ``name``, ``arguments`` and, optionally, ``after``: ids that have to be
settled before) or with ``tool_call_id`` (the result of that call). Calls and
results of a conversation meet in a join on their id. What a message waits for
has to come before it: a result after its call, a call after the results (or
else the calls) it names in ``after``. Messages keep the order of their turns
wherever that agrees; those that come too early move behind what they wait for.

The order is a sort key per message, ``order_at, order_depth, turn, kind``, not a
position: no conversation, however long, is brought together in one task. Only
the waits of conversations in which a message comes too early are followed.
Arguments are checked against their tool's schema, and every message is
written as JSON with sorted keys and without blanks.

Defined results. ``status`` of a call: ``answered``, ``unanswered``, or
``repeated`` when an earlier call of the conversation has its id; of a result:
``linked``, ``orphan`` without a call, or ``repeated`` when an earlier message
answers the call; ``plain`` for others, ``cycle`` where messages wait for each
other, or for some that do. Messages of one turn: calls before results. An entry
of ``tool_calls`` that is no object is a call without an id, with an error. Ids
that are no strings count by their JSON. A number beyond doubles is not JSON; half
a surrogate pair becomes a replacement mark; other fields of a message stay in
its JSON. NULL text reads as empty. Text that is not such an object, or not JSON,
is plain. NULL conversations or ids link to nothing. Repeated rows are messages
of their own; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.session import staged

Schema = dict
HALVES = re.compile("[\ud800-\udfff]")
LOCAL = 100_000  # waits of a conversation up to which one task orders it

CALL = "struct<id: string, name: string, arguments: string, errors: string, after: array<string>>"
READ = f"conv_id long, turn long, role string, kind string, calls array<{CALL}>, call_id string, json string"


def canonical(value: object) -> str:
    """JSON with sorted keys and no blanks; whole numbers without a fraction.

    Walks with a stack of its own, so that depth is no limit. Half of a surrogate
    pair is no character and becomes a replacement mark.
    """
    out: list[str] = []
    rest: list[tuple[bool, object]] = [(False, value)]  # what is still to be written; True: as it is
    while rest:
        ready, x = rest.pop()
        if ready:
            out.append(x)
        elif isinstance(x, dict):
            parts = [(False, x[k]) if i else (True, f"{json.dumps(k, ensure_ascii=False)}:") for k in sorted(x) for i in (0, 1)]
            commas = [part for i, part in enumerate(parts) for part in ([(True, ",")] if i and i % 2 == 0 else []) + [part]]
            rest += [(True, "}"), *reversed(commas), (True, "{")]
        elif isinstance(x, list):
            commas = [part for i, v in enumerate(x) for part in ([(True, ",")] if i else []) + [(False, v)]]
            rest += [(True, "]"), *reversed(commas), (True, "[")]
        else:
            whole = isinstance(x, float) and x.is_integer() and abs(x) < 2**53
            out.append(json.dumps(int(x) if whole else x, ensure_ascii=False))
    return characters("".join(out))


def characters(text: str) -> str:
    """The text with a replacement mark for every half of a surrogate pair."""
    return HALVES.sub("\ufffd", text)


def _is(kind: str, value: object) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return {
        "null": value is None,
        "boolean": isinstance(value, bool),
        "integer": number and (isinstance(value, int) or value.is_integer()),
        "number": number,
        "string": isinstance(value, str),
        "array": isinstance(value, list),
        "object": isinstance(value, dict),
    }.get(kind, False)


def violations(value: object, schema: Schema, at: str = "$") -> list[str]:
    """Where a value breaks a schema of types, ranges, lengths, patterns, enumerations and parts."""
    found = []
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(k, value) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not one of the allowed values")
    if _is("number", value):
        if value < schema.get("minimum", -math.inf) or value > schema.get("maximum", math.inf):
            found.append(f"{at}: out of range")
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
            found.append(f"{at}: wrong length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            found.append(f"{at}: does not match")
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf):
            found.append(f"{at}: wrong number of items")
        for i, item in enumerate(value):
            found += violations(item, schema.get("items", {}), f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{name}: missing" for name in schema.get("required", []) if name not in value]
        for name, part in sorted(value.items()):
            if name in known:
                found += violations(part, known[name], f"{at}.{name}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{name}: not allowed")
    return found


def _refuse(name: str) -> float:
    raise ValueError(f"{name} is not JSON")


def _number(digits: str) -> float:
    """A number with a fraction or an exponent; one that no double holds is refused."""
    value = float(digits)
    return value if math.isfinite(value) else _refuse(digits)


def parse(text: str) -> object:
    """The value of a JSON text; None when it is not one."""
    try:
        return json.loads(text, parse_constant=_refuse, parse_float=_number)
    except (ValueError, RecursionError):
        return None


def read_call(call: object, schemas: dict[str, Schema]) -> dict:
    """A call's parts, with canonical arguments and what is wrong with them; ``shown`` is how it is written."""
    if not isinstance(call, dict):
        whole = canonical(call)
        return {"id": None, "name": None, "arguments": whole, "errors": "not an object", "after": [], "shown": call}
    inner = call["function"] if isinstance(call.get("function"), dict) else call
    name, given = inner.get("name"), inner.get("arguments")
    value = parse(given) if isinstance(given, str) else given
    if not isinstance(name, str) or name not in schemas:
        errors = ["unknown tool"]
    elif not isinstance(value, dict):
        errors = ["arguments are not an object"]
    else:
        errors = violations(value, schemas[name])
    after = call.get("after") if isinstance(call.get("after"), list) else []
    id = None if call.get("id") is None else as_text(call["id"])
    name = None if name is None else as_text(name)
    arguments = value if isinstance(value, dict) else given
    others = {k: v for k, v in call.items() if k != "function"}
    return {
        "id": id,
        "name": name,
        "arguments": canonical(arguments),
        "errors": characters("; ".join(errors)),
        "after": [as_text(a) for a in after if a is not None],
        "shown": {**others, "id": id, "name": name, "arguments": arguments},
    }


def as_text(id: object) -> str:
    """An identifier as text: strings as they are, anything else as canonical JSON."""
    return characters(id) if isinstance(id, str) else canonical(id)


def read_message(role: str | None, text: str | None, schemas: dict[str, Schema]) -> tuple:
    """``kind, calls, call_id, json`` of a message."""
    text = text or ""
    body = parse(text) if text.lstrip()[:1] == "{" else None
    out: dict = {"role": role, "content": text}
    calls, answered, kind = [], None, "plain"
    if isinstance(body, dict) and isinstance(body.get("tool_calls"), list):
        calls, kind = [read_call(x, schemas) for x in body["tool_calls"]], "call"
        shown = [c.pop("shown") for c in calls]
        out = {**body, "role": role, "content": body.get("content"), "tool_calls": shown}
    elif isinstance(body, dict) and body.get("tool_call_id") is not None:
        answered, kind = as_text(body["tool_call_id"]), "result"
        out = {**body, "role": role, "content": body.get("content"), "tool_call_id": answered}
    return kind, calls, answered, canonical(out)


def read(
    messages: DataFrame,
    schemas: dict[str, Schema],
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Every message taken apart and in canonical JSON."""
    call = pa.struct(
        [(n, pa.string()) for n in ("id", "name", "arguments", "errors")] + [("after", pa.list_(pa.string()))]
    )

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ("conv_id", "turn", "role", "kind", "calls", "call_id", "json")]
        for batch in rows:
            found = [
                read_message(r.as_py(), t.as_py(), schemas) for r, t in zip(batch.column(2), batch.column(3))
            ]
            kinds = [pa.string(), pa.list_(call), pa.string(), pa.string()]
            columns = [pa.array([f[i] for f in found], type=kinds[i]) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names)

    picked = messages.select(
        F.col(key).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.col(role).alias("role"),
        F.col(text).alias("text"),
    )
    return picked.mapInArrow(batches, READ)


MOVED = "conv_id long, turn long, at long, depth int, cycle boolean"


def _order(waits: pd.DataFrame) -> pd.DataFrame:
    """``conv_id, turn, at, depth, cycle`` of the messages of whole conversations that wait, and of what they wait for.

    Messages are settled once all that they wait for is; what never is, waits in a cycle.
    """
    ends = np.concatenate([waits[["conv_id", "before"]].to_numpy(), waits[["conv_id", "turn"]].to_numpy()])
    known, place = np.unique(ends, axis=0, return_inverse=True)
    turns, place = known[:, 1], place.reshape(-1)
    before, turn = place[: len(waits)], place[len(waits) :]
    order = np.argsort(before, kind="stable")
    first = np.searchsorted(before[order], np.arange(len(turns) + 1))
    then = turn[order]
    missing = np.bincount(turn, minlength=len(turns))
    at, depth = turns.copy(), np.zeros(len(turns), dtype=np.int64)
    ready = np.flatnonzero(missing == 0).tolist()
    while ready:
        one = ready.pop()
        for other in then[first[one] : first[one + 1]].tolist():
            if (at[one], depth[one] + 1) > (at[other], depth[other]):
                at[other], depth[other] = at[one], depth[one] + 1
            missing[other] -= 1
            if not missing[other]:
                ready.append(other)
    return pd.DataFrame(
        {"conv_id": known[:, 0], "turn": turns, "at": at, "depth": depth.astype(np.int32), "cycle": missing > 0}
    )


def _settled(waits: DataFrame, local: int = LOCAL) -> DataFrame:
    """``conv_id, turn, at, depth, cycle`` of the messages that wait.

    ``waits`` has ``conv_id, before, turn``: the message of turn ``turn`` comes
    after that of turn ``before``. A message comes at the latest turn among all
    that it waits for, directly or not, as deep as the longest chain from there.
    A conversation of at most ``local`` waits is ordered in one task, together with
    others, so that a group has about so many. Longer ones
    are peeled: a round settles all messages that wait for settled ones only, and
    as soon as a round settles none, what is left waits in a cycle.
    """
    counts = staged(waits.groupBy("conv_id").agg(F.count(F.lit(1)).alias("waits")), "chat-waits")
    long = counts.filter(F.col("waits") > local).select("conv_id")
    short = waits.join(long, "conv_id", "left_anti")
    groups = max(1, math.ceil(waits.count() / local))
    dealt = short.withColumn("group", F.pmod(F.xxhash64("conv_id"), F.lit(groups)))
    found = dealt.groupBy("group").applyInPandas(_order, MOVED)
    if long.isEmpty():
        return found
    edges = staged(waits.join(long, "conv_id"), "chat-long")
    ends = edges.select("conv_id", F.explode(F.array("before", "turn")).alias("turn")).distinct()
    waiting = edges.select("conv_id", "turn").distinct()
    fresh = ends.join(waiting, ["conv_id", "turn"], "left_anti").select(
        "conv_id", "turn", F.col("turn").alias("at"), F.lit(0).alias("depth")
    )
    settled = fresh = staged(fresh, "chat-settled")
    while not fresh.isEmpty():
        best = F.max(F.struct(F.col("at"), (F.col("depth") + 1).alias("depth"))).alias("first")
        come = fresh.withColumnRenamed("turn", "before").join(edges, ["conv_id", "before"])
        asked = edges.join(come.select("conv_id", "turn").distinct(), ["conv_id", "turn"])
        known = settled.withColumnRenamed("turn", "before")
        full = asked.join(known, ["conv_id", "before"], "left").groupBy("conv_id", "turn")
        full = full.agg(best, F.count_if(F.col("at").isNull()).alias("missing")).filter("missing = 0")
        own = F.struct(F.col("turn").alias("at"), F.lit(0).alias("depth"))
        place = full.select("conv_id", "turn", F.greatest("first", own).alias("place"))
        fresh = staged(place.select("conv_id", "turn", "place.at", "place.depth"), "chat-fresh")
        settled = staged(settled.unionByName(fresh), "chat-settled")
    left = ends.join(settled, ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        F.coalesce("at", "turn").alias("at"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.col("at").isNull().alias("cycle"),
    )
    return found.unionByName(left)


def linked(
    messages: DataFrame,
    schemas: dict[str, Schema],
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``conv_id, turn, role, kind, call_id, linked_turn, status, errors, order_at, order_depth, json``.

    One row per message and call (a message with several calls has a row for
    each). ``linked_turn`` is where a result's call, or a call's result, stands.
    """
    read_once = staged(read(messages, schemas, key, turn, role, text), "chat-read")
    rows = read_once.withColumn("call", F.explode_outer("calls")).select(
        "conv_id",
        "turn",
        "role",
        "kind",
        F.coalesce("call.id", "call_id").alias("call_id"),
        F.coalesce("call.errors", F.lit("")).alias("errors"),
        F.col("call.after").alias("after"),
        "json",
    )
    ids = ["conv_id", "call_id"]
    first = lambda kind, name: (
        rows.filter(F.col("kind") == kind).filter("call_id IS NOT NULL").groupBy(*ids).agg(F.min("turn").alias(name))
    )
    ends = first("call", "called").join(first("result", "answered"), ids, "full")
    ends = staged(ends, "chat-links")

    met = rows.join(ends, ids, "left")
    status = (
        F.when(F.col("kind") == "plain", "plain")
        .when((F.col("kind") == "call") & (F.col("turn") > F.col("called")), "repeated")
        .when(F.col("kind") == "call", F.when(F.col("answered").isNull(), "unanswered").otherwise("answered"))
        .when(F.col("called").isNull(), "orphan")
        .when(F.col("turn") > F.col("answered"), "repeated")
        .otherwise("linked")
    )
    own = met.select("conv_id", F.col("called").alias("before"), "turn").filter(
        (F.col("kind") == "result") & F.col("before").isNotNull()
    )
    named = rows.filter(F.size("after") > 0).select("conv_id", "turn", F.explode("after").alias("call_id"))
    named = named.join(ends, ids).select("conv_id", F.coalesce("answered", "called").alias("before"), "turn")
    # At one turn a call comes before its result anyhow; a call that names itself waits for ever.
    own = own.filter("before <> turn")
    waits = own.unionByName(named).filter(F.col("turn").isNotNull()).distinct()
    waits = staged(waits, "chat-order")
    moved = waits.limit(0).selectExpr("conv_id", "turn", "turn AS at", "0 AS depth", "false AS cycle")
    late = waits.filter("before >= turn").select("conv_id").distinct()
    if not late.isEmpty():
        # Only conversations in which some message comes too early.
        moved = staged(_settled(staged(waits.join(late, "conv_id"), "chat-early")), "chat-moved")

    other = F.when(F.col("kind") == "call", F.col("answered")).when(F.col("kind") == "result", F.col("called"))
    return (
        met.withColumn("linked_turn", other)
        .withColumn("status", status)
        .join(moved, ["conv_id", "turn"], "left")
        .select(
            "conv_id",
            "turn",
            "role",
            "kind",
            "call_id",
            "linked_turn",
            F.when(F.coalesce("cycle", F.lit(False)), "cycle").otherwise(F.col("status")).alias("status"),
            "errors",
            F.when(F.coalesce("cycle", F.lit(False)), F.col("turn"))
            .otherwise(F.coalesce("at", "turn"))
            .alias("order_at"),
            F.when(F.coalesce("cycle", F.lit(False)), 0).otherwise(F.coalesce("depth", F.lit(0))).alias("order_depth"),
            "json",
        )
    )
