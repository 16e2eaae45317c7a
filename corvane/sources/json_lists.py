"""Files that are one JSON list each, of any size, read in byte ranges.

A list has no line structure, so the files are read in pieces that end at a
comma; such a piece is never longer than one element. Spark cuts the files into
ranges and the pieces of a range come in order. Pieces that follow each other are
joined to chunks, and those are stored: all else works on chunks, so it does not
matter how Spark would cut the files another time. What a chunk does to a reader
is a step of a small automaton: whether it ends inside a string, and by how much
the depth of brackets changes, for either way of coming in. These steps, a row
per chunk, are composed along each file; then every chunk knows where it stands
and cuts its elements at the commas of depth one. An element that lies across
chunks is put together from its fragments alone.

The files are scanned once and the chunks three times (steps, elements,
fragments); no value is longer than a chunk or an element. A compressed file is
one range.

Defined results. Elements are the texts between the list's commas, without the
blanks around them; what is broken inside an element is found by whoever parses
it. An empty list has none. A file whose brackets do not close, or that has
anything after its list, is no list.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corvane.session import staged
from corvane.sources.splits import many_to_a_task

SPLITS = 1_000_000  # rows of the broadcast table of chunks
CHUNK = 1 << 18  # bytes from which a chunk is full
SENT = 1 << 22  # bytes of chunks or elements in an Arrow batch
COMMA, QUOTE, BACKSLASH = 44, 34, 92
BLANK = np.zeros(256, dtype=bool)
BLANK[list(b" \t\r\n")] = True
STEP = np.zeros(256, dtype=np.int8)
STEP[list(b"[{")], STEP[list(b"]}")] = 1, -1
SIGN = STEP != 0
SIGN[[COMMA, QUOTE, BACKSLASH]] = True

CHUNKS = "file string, block long, chunk binary"
STEPS = "file string, block long, head string, " + ", ".join(
    f"{name}_{way} {kind}"
    for way in (0, 1)
    for name, kind in (("quoted", "int"), ("depth", "long"), ("low", "long"), ("loose", "long"), ("after", "int"))
)
PLACES = "file string, block long, quoted int, depth long, last boolean, listed boolean"


def pieces(spark: SparkSession, paths: Sequence[str], tolerant: bool = False) -> DataFrame:
    """``file, block, seq, piece``: the files between their commas."""
    options = {"ignoreCorruptFiles": str(tolerant).lower(), "ignoreMissingFiles": str(tolerant).lower()}
    found = spark.read.options(**options).text(list(paths), lineSep=",").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").cast("binary").alias("piece"),
    )
    return many_to_a_task(found)


def chunks(spark: SparkSession, paths: Sequence[str], tolerant: bool = False) -> DataFrame:
    """``file, block, chunk``: pieces in their order, a comma after each, joined to chunks (stored).

    ``block`` grows along the file: where the range begins, and for its later
    chunks the bytes before them less one, for a range may read on to the place
    where the next one begins.
    """
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, bytes]] = []
        key, before, held, size = None, 0, [], 0

        def close() -> None:
            nonlocal before, held, size
            if held:
                out.append((key[0], key[1] + max(before - 1, 0), b"".join(held)))
            before, held, size = before + size, [], 0

        def packed() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.binary()))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            ends = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column("piece")).to_numpy().astype(np.int64))])
            data = batch.column("piece")
            for file, block, first, end in _runs(batch):
                if key != (file, block):
                    close()
                    key, before = (file, block), 0
                while first < end:
                    # As many pieces as fill the chunk, one at least.
                    upto = min(end, int(np.searchsorted(ends, ends[first] + CHUNK - size)))
                    upto = max(upto, first + 1)
                    held.append(b"".join(data.slice(first, upto - first).to_pylist()))
                    size, first = size + len(held[-1]), upto
                    if size >= CHUNK:
                        close()
                        if sum(len(r[2]) for r in out) >= SENT:
                            yield packed()
        close()
        yield packed()

    found = pieces(spark, paths, tolerant)
    found = found.select("file", "block", F.concat("piece", F.lit(b",")).alias("piece"))
    return many_to_a_task(staged(found.mapInArrow(run, CHUNKS), "json-chunks"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """Rows of one range after another: ``file, block, first, end``."""
    if not batch.num_rows:
        return
    files, blocks = batch.column("file"), batch.column("block").to_numpy()
    other = pc.not_equal(files.slice(1), files.slice(0, len(files) - 1)).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(other | (blocks[1:] != blocks[:-1])) + 1).tolist(), batch.num_rows]
    for first, end in zip(cuts, cuts[1:]):
        yield files[first].as_py(), int(blocks[first]), first, end


class Signs:
    """The signs of a chunk that count: quotes that are not escaped, brackets and commas.

    ``at`` has their places, ``code`` the bytes, ``inside`` whether a string is
    open behind each, if none was before the chunk. A chunk begins behind a comma,
    so nothing before it escapes a sign.
    """

    def __init__(self, raw: bytes):
        self.text = np.frombuffer(raw, dtype=np.uint8)
        at = np.flatnonzero(SIGN[self.text])
        code = self.text[at]
        slash, places = code == BACKSLASH, np.arange(len(at))
        # Behind how many backslashes in a row a sign stands: back to the latest sign that is none or has no neighbour.
        broken = ~slash
        broken[:-1] |= at[1:] != at[:-1] + 1
        since = np.maximum.accumulate(np.where(broken, places, -1))
        since = np.concatenate([[-1], since[:-1]])
        escaped = (places - 1 - since) % 2 == 1
        kept = ~slash & ~((code == QUOTE) & escaped)
        self.at, self.code = at[kept], code[kept]
        self.inside = np.cumsum(self.code == QUOTE) % 2 == 1

    def depths(self, quoted: np.ndarray, depth: int) -> np.ndarray:
        """The depth behind every sign, where brackets inside strings do not count."""
        return depth + np.cumsum(np.where(quoted, 0, STEP[self.code]), dtype=np.int64)

    def step(self, way: int, filled: np.ndarray) -> tuple[int, int, int, int, int]:
        """What the chunk does to a reader that comes in that way: ``quoted, depth, low, loose, after``.

        ``loose`` counts what is neither blank nor closes a bracket at the lowest
        depth, ``after`` says whether the last comma, which may be ours, is such
        a sign too. ``filled`` has the bytes before each place that are not blank.
        """
        quoted = self.inside ^ bool(way)
        depth = self.depths(quoted, 0)
        before = np.concatenate([[0], depth[:-1]])
        low = int(depth.min(initial=0))
        lowest = before == low
        begin = np.concatenate([[0], self.at[:-1] + 1])
        between = (filled[self.at] - filled[begin])[lowest].sum()
        signs = lowest & (depth >= low)
        return int(quoted[-1]), int(depth[-1]), low, int(between + signs[:-1].sum()), int(signs[-1])


def steps(found: DataFrame) -> DataFrame:
    """One row per chunk: its first sign, and what it does for either way of coming in."""
    names = [c.split()[0] for c in STEPS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string()] + [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, block, chunk in zip(*(batch.column(c) for c in ("file", "block", "chunk"))):
                raw = chunk.as_py()
                signs = Signs(raw)
                filled = np.concatenate([[0], np.cumsum(~BLANK[signs.text], dtype=np.int32)])
                head = raw.lstrip(b" \t\r\n")[:1].decode("ascii", "replace")
                rows.append([file.as_py(), block.as_py(), head, *signs.step(0, filled), *signs.step(1, filled)])
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return found.mapInArrow(run, STEPS)


def _places(rows: pd.DataFrame) -> pd.DataFrame:
    """Where every chunk of one file begins: the steps before it, one after the other."""
    rows = rows.sort_values("block")
    quoted, depth, loose, out, sound = 0, 0, 0, [], True
    end = rows["block"].max()
    for row in rows.itertuples():
        way = "1" if quoted else "0"
        out.append((quoted, depth))
        low = getattr(row, f"low_{way}")
        sound &= depth + low >= 0
        if depth + low == 0:
            # The comma behind the last chunk is ours.
            loose += getattr(row, f"loose_{way}") + (getattr(row, f"after_{way}") if row.block != end else 0)
        quoted, depth = getattr(row, f"quoted_{way}"), depth + getattr(row, f"depth_{way}")
    heads = [h for h in rows["head"] if h]
    # All that stands at depth 0 is the bracket that opens the list.
    listed = sound and not quoted and depth == 0 and loose == 1 and heads[:1] == ["["]
    return pd.DataFrame(
        {
            "file": rows["file"],
            "block": rows["block"],
            "quoted": [q for q, _ in out],
            "depth": [d for _, d in out],
            "last": rows["block"] == end,
            "listed": listed,
        }
    )


def places(found: DataFrame) -> DataFrame:
    """``file, block, quoted, depth, last, listed`` of every chunk (stored: a row per chunk)."""
    done = staged(steps(found), "json-steps")
    return staged(done.groupBy("file").applyInPandas(_places, PLACES), "json-places")


WHOLE, END, BEGIN, MIDDLE = range(4)  # an element, the end of one, the beginning of one, neither end
CUT = "file string, block long, seq long, kind int, line string"


def _elements(block: int, quoted: int, depth: int, last: bool, raw: bytes) -> Iterator[tuple[int, int, str | None]]:
    """``seq, kind, line``: the elements of a chunk and the fragments at its ends."""
    signs = Signs(raw)
    inside = signs.inside ^ bool(quoted)
    commas = signs.at[(signs.code == COMMA) & ~inside & (signs.depths(inside, depth) == 1)].tolist()
    if last and commas and commas[-1] == len(raw) - 1:
        commas.pop()  # ours
    seq, at, whole = 0, 0, block == 0
    if whole:
        at = raw.index(b"[") + 1
    for comma in commas:
        yield seq, WHOLE if whole else END, raw[at:comma].decode(errors="replace")
        seq, at, whole = seq + whole, comma + 1, True
    rest = raw[at:-1].decode(errors="replace")  # without the comma behind the chunk
    if last:
        rest = rest.rstrip(" \t\r\n").removesuffix("]")
        # Nothing at all between the brackets is no element.
        if not whole or seq or rest.strip():
            yield seq, WHOLE if whole else END, rest
    elif at < len(raw):
        yield seq, BEGIN if whole else MIDDLE, rest
    else:
        # The chunk ends with a comma of the list: an element begins behind it, with nothing here.
        yield seq, BEGIN, None


def _cut(found: DataFrame, fragments: bool) -> DataFrame:
    """Whole elements, or the fragments of those that lie across chunks."""
    names = [c.split()[0] for c in CUT.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for row in zip(*(batch.column(c) for c in ("file", "block", "quoted", "depth", "last", "chunk"))):
                file, block, *rest = (x.as_py() for x in row)
                for seq, kind, line in _elements(block, *rest):
                    if (kind != WHOLE) == fragments:
                        out.append((file, block, seq, kind, line.strip(" \t\r\n") if kind == WHOLE else line))
                        held += len(line or "")
                if held > SENT:
                    yield packed(out)
                    out, held = [], 0
            yield packed(out)

    return found.mapInArrow(run, CUT)


def elements(found: DataFrame, where: DataFrame) -> DataFrame:
    """``file, block, seq, line``: the elements of the files, given their chunks and the ``places`` of these.

    ``block`` is the chunk in which an element begins, ``seq`` its number there.
    """
    known = where.filter("listed").drop("listed")
    rows = found.join(F.broadcast(known) if known.count() <= SPLITS else known, ["file", "block"])
    whole = _cut(rows, False).select("file", "block", "seq", "line")
    # An element across chunks: a beginning, chunks in its midst, an end. Chunks without any comma of the list are midst.
    parts = staged(_cut(rows, True), "json-fragments")
    begun = parts.filter(F.col("kind") == BEGIN).select(
        "file", F.col("block").alias("begun"), "seq", F.col("line").alias("head")
    )
    # A row per chunk at most: which beginning a fragment follows is the latest one before it.
    none = F.lit(None)
    marks = begun.select("file", F.col("begun").alias("block"), none.cast("string").alias("line"), F.lit(1).alias("turn"), "begun")
    tails = parts.filter(F.col("kind") != BEGIN).select("file", "block", "line", F.lit(0).alias("turn"), none.cast("long").alias("begun"))
    upto = Window.partitionBy("file").orderBy("block", "turn")
    placed = marks.unionByName(tails).withColumn("begun", F.last("begun", True).over(upto)).filter("line IS NOT NULL")
    inner = F.array_sort(F.collect_list(F.struct("block", "line")))["line"]
    ends = placed.groupBy("file", "begun").agg(F.array_join(inner, ",").alias("tail"))
    across = begun.join(ends, ["file", "begun"], "left")
    text = F.concat_ws(",", "head", "tail")
    blanks = F.lit(" \t\r\n")
    return whole.unionByName(across.select("file", F.col("begun").alias("block"), "seq", F.btrim(text, blanks).alias("line")))
