"""Encode texts with a merge-type SentencePiece vocabulary, and decode them again.

The text, with a mark for every space and one before its start, begins as
single characters. An agenda holds each adjacent pair that is a piece of the
vocabulary, best score first and leftmost among equals; the best pair merges,
its new neighbours enter the agenda, and entries whose parts have changed since
are passed over. Characters that are no piece become their UTF-8 bytes.

No piece has the space mark after another character, or a sign such as a comma or
a digit after a Latin letter, so no merge crosses these places: a text is worked on
unit by unit and in blocks of bounded length. Each different unit is worked out once
while a process remembers it, and then checked: all that are new in a block go
through the library's encoder and decoder, as one text. ``agrees`` says whether all
units of a text came out equal.

Defined results. NULL text reads as empty, which has no ids; a space mark in a
text reads as a space, so it decodes to one. Rows are encoded one by one, so
repeated rows get the same result; an empty table gives no rows. Only the named
columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from sentencepiece import sentencepiece_model_pb2

# Fixed values of the model format.
MARK = "▁"  # stands for a space
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGES = 2  # model type

LETTER = "a"
BLOCK = 1 << 16  # characters worked on at a time
UNIT = 64  # characters up to which a unit is kept
KNOWN = 1_000_000  # units that a process holds; they are dropped beyond that
SIGNS = re.escape("".join(c for c in map(chr, range(128)) if not c.isalpha()))  # of ASCII, no letters
LATIN = "[A-Za-zÀ-ɏ]"
#: Units, from fine to coarse, each with what no piece may have in it for them.
UNITS = [
    (
        re.compile(f"{MARK}*[{SIGNS}]*(?:[^{MARK}{SIGNS}]+|(?<!{LATIN})[{SIGNS}])*"),
        re.compile(f"[^{MARK}]{MARK}|{LATIN}[{SIGNS}]"),
    ),
    (re.compile(f"{MARK}*[^{MARK}]*"), re.compile(f"[^{MARK}]{MARK}")),
]
CUT = re.compile(f"(?<=[^{MARK}]){MARK}(?=.)", re.DOTALL)


class Unit(NamedTuple):
    decimal: bytes  # ids as decimal numbers with commas
    decoded: str
    agrees: bool  # with the library


def _utf8(run: bytes) -> str:
    """Bytes as text; each byte that is no part of a character is a replacement mark."""
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[at : at + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            size = 1
        at += size
    return "".join(out)


class PieceEncoder:
    """A vocabulary, read from the bytes of its model file."""

    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        kinds = {p.type for p in proto.pieces}
        normal = proto.normalizer_spec
        plain = normal.add_dummy_prefix and normal.escape_whitespaces and not normal.precompiled_charsmap
        if (
            proto.trainer_spec.model_type != MERGES
            or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}
            or not plain
            or normal.remove_extra_whitespaces
            or proto.trainer_spec.treat_whitespace_as_suffix
        ):
            raise ValueError("only merge-type models that leave texts as they are, with a space before the start")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.unknown_surface = proto.trainer_spec.unk_surface
        self.unknown = self.kinds.index(UNKNOWN)
        self.known = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        order = {score: n for n, score in enumerate(sorted({p.score for p in proto.pieces}, reverse=True))}
        self.ranks = {p.piece: order[p.score] for p in proto.pieces if p.type == NORMAL}  # pieces of one score share one
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        normal = [k == NORMAL for k in self.kinds]
        self.surfaces = [p.replace(MARK, " ") if own else None for p, own in zip(self.pieces, normal)]
        self.decimal = [str(i).encode() for i in range(len(self.pieces))]
        self.cuts = next((u for u, no in UNITS if not any(map(no.search, self.known))), None)
        self.units: dict[str, Unit] = {}

    def merge(self, text: str) -> list[str]:
        """The symbols that are left when no adjacent pair is a piece.

        An entry of the agenda is one number: rank of the merged piece, left
        symbol, length of the piece. It is stale when the left symbol is gone, or
        it and its neighbour now have another length together.
        """
        rank, symbols, end = self.ranks.get, list(text), len(text)
        bits = end.bit_length() + 1
        mask, high = (1 << bits) - 1, 2 * bits
        agenda = [r << high | i << bits | 2 for i in range(end - 1) if (r := rank(text[i : i + 2])) is not None]
        if not agenda:
            return symbols
        heapify(agenda)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        while agenda:
            entry = heappop(agenda)
            left = entry >> bits & mask
            a, right = symbols[left], after[left]
            if not a or right >= end or len(a) + len(symbols[right]) != entry & mask:
                continue
            symbols[left] = a = a + symbols[right]
            symbols[right] = ""
            after[left] = beyond = after[right]
            if beyond < end:
                before[beyond] = left
                pair = a + symbols[beyond]
                if (r := rank(pair)) is not None:
                    heappush(agenda, r << high | left << bits | len(pair))
            if (prior := before[left]) >= 0:
                pair = symbols[prior] + a
                if (r := rank(pair)) is not None:
                    heappush(agenda, r << high | prior << bits | len(pair))
        return [s for s in symbols if s]

    def ids(self, marked: str) -> list[int]:
        """Ids of a text that has its space marks."""
        out: list[int] = []
        known = self.known.get
        for symbol in self.merge(marked):
            if (found := known(symbol)) is not None:
                out.append(found)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in symbol.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)  # unknown characters in a row are one
        return out

    def surface(self, ids: list[int]) -> str:
        """Ids as text, with the space before the start where there is one."""
        plain = [self.surfaces[i] for i in ids]
        if None not in plain:
            return "".join(plain)
        out, run = [], bytearray()
        for i in [*ids, -1]:
            if i in self.bytes_of:
                run.append(self.bytes_of[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if i >= 0 and self.kinds[i] == UNKNOWN:
                out.append(self.unknown_surface)
            elif i >= 0 and self.kinds[i] == NORMAL:
                out.append(self.surfaces[i])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        first = next((i for i in ids if i in self.bytes_of or self.kinds[i] != CONTROL), None)
        marked = first is not None and self.kinds[first] == NORMAL and self.pieces[first].startswith(MARK)
        return self.surface(ids)[marked:]

    def learn(self, fresh: list[str]) -> dict[str, Unit]:
        """Work units out, and check them against the library: all in one text, or else one by one."""
        own = {u: self.ids(u) for u in fresh}
        decoded = {u: self.surface(ids) for u, ids in own.items()}
        # The library puts a space before any text. Units that begin with a sign follow a letter here.
        ahead = {u: "" if u.startswith(MARK) else MARK + LETTER for u in fresh}
        before, said = {"": [], MARK + LETTER: self.library.encode(LETTER)}, {"": "", MARK + LETTER: " " + LETTER}

        def same(units: list[str]) -> bool:
            theirs = self.library.encode("".join([ahead[u] + u for u in units])[1:])
            ours = [i for u in units for i in before[ahead[u]] + own[u]]
            text = "".join([said[ahead[u]] + decoded[u] for u in units])
            # Alone, the space before a text is nothing.
            return theirs == ours and self.library.decode(theirs) == text[1:] or units == [MARK]

        every = same(fresh)
        return {
            u: Unit(b",".join([self.decimal[i] for i in ids]), decoded[u], every or same([u])) for u, ids in own.items()
        }

    def blocks(self, text: str, size: int = BLOCK) -> Iterator[list[Unit]]:
        """The units of a text, some at a time; the first one begins with the space before the start."""
        marked = MARK + text.replace(" ", MARK) if text else ""
        known, at = self.units, 0
        while at < len(marked):
            end = len(marked)
            if self.cuts and end - at > size and (cut := CUT.search(marked, at + size)):
                end = cut.start()
            block = marked[at:end]
            names = self.cuts.findall(block)[:-1] if self.cuts else [block]
            found = [known.get(u) for u in names]
            if None in found:
                fresh = self.learn(list({u for u, had in zip(names, found) if had is None}))
                if len(known) > KNOWN:
                    known.clear()
                known.update((u, unit) for u, unit in fresh.items() if len(u) <= UNIT)
                found = [had or fresh[u] for u, had in zip(names, found)]
            yield found
            at = end


@lru_cache(maxsize=2)
def encoder_of(model: bytes) -> PieceEncoder:
    """The process's encoder of a model, with the units that earlier tasks have met."""
    return PieceEncoder(model)


def encoded(
    docs: DataFrame, model: str, id: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, agrees``; also ``ids, decoded`` when asked for.

    ``model`` is the path of a model file; it is read here, once, and sent to
    the executors (a vocabulary, not data).
    """
    spark = docs.sparkSession
    with open(model, "rb") as file:
        content = spark.sparkContext.broadcast(file.read())
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string())]
    fields += [("decoded_sha256", pa.string()), ("agrees", pa.bool_())]
    if with_ids:
        fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean"
    schema += ", ids array<int>, decoded string" if with_ids else ""

    def row(encoder: PieceEncoder, text: str) -> list:
        ids_hash, text_hash, count, agrees = sha256(), sha256(), 0, True
        numbers, texts = [], []
        for units in encoder.blocks(text):
            decimal = b",".join([u.decimal for u in units])
            decoded = "".join([u.decoded for u in units])
            ids_hash.update(b"," + decimal if count else decimal)
            surface = decoded if count else decoded[1:]
            text_hash.update(surface.encode())
            count += decimal.count(b",") + 1
            agrees = agrees and all([u.agrees for u in units])
            if with_ids:
                numbers += map(int, decimal.split(b","))
                texts.append(surface)
        found = [count, ids_hash.hexdigest(), text_hash.hexdigest(), agrees]
        return found + ([numbers, "".join(texts)] if with_ids else [])

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(content.value)
        for batch in rows:
            found = [row(encoder, value.as_py() or "") for value in batch.column(1)]
            columns = [pa.array([r[i] for r in found], type=kind) for i, (_, kind) in enumerate(fields[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [name for name, _ in fields])

    picked = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(batches, schema)
