"""Packing: the exact ids come back from the sequences, and little room is lost."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from corvane.llm import packing
from corvane.llm.tokenizing import ChunkEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, piece string"
ODD = [
    None,
    "",
    " \n\t",
    "a b c\x1cd <|endoftext|>x y<|startoftext|>",
    "\x01 a\x01b É ́a ΑΣ ΣΑΣ don't it's 'S I'M we'll",
    "ǅ İstanbul ﬁ ½ 漢字 🙂🙂 x",
    "... ,,, !?! ​ ﻿ a b c\x85d",
    "É́ É́. ŒUVRE, ÿ' 'tis ª º µ 12 1a a1 b-c THE!! on***",
]


def plain_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def test_chunks_give_the_tokenizers_ids():
    encoder = ChunkEncoder(open(PATH, encoding="utf-8").read())
    for text in ODD:
        raw = encoder.encode((text or "").encode())
        assert np.frombuffer(raw, "<u4").tolist() == plain_ids(text)[:-1]


def test_round_trip(spark):
    long = " ".join(f"word{i} Éa." for i in range(4000))
    rows = [(i, t, "x", "y") for i, t in enumerate([*ODD, long, long, "a " * 2047, "a " * 2048])]
    rows.append(rows[5])  # a repeated row
    df = spark.createDataFrame(rows, SCHEMA)
    pieces = packing.packed(df, PATH, with_ids=True)
    found = [r.asDict() for r in pieces.collect()]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, text, *_ in rows[:-1]:
        times = 2 if doc == 5 else 1
        own = sorted(by_doc[doc], key=lambda r: r["start"])
        ids = [i for r in own[::times] for i in r["ids"]]
        assert ids == plain_ids(text) and {r["doc_tokens"] for r in own} == {len(ids)}
        assert len(own) == times * -(-len(ids) // 2048)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    joined = {r["sequence_id"]: r for r in packing.sequences(pieces).collect()}
    for key, own in by_sequence.items():
        ids = [i for r in sorted(own, key=lambda r: r["offset"]) for i in r["ids"]]
        assert joined[key]["ids"] == ids and joined[key]["length"] == len(ids)


def test_first_fit_decreasing_is_what_it_says():
    draw = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 257):
        lengths = draw.integers(1, 100, n)
        sequence, offset = packing.first_fit_decreasing(lengths, 100)
        used: list[int] = []
        for piece in np.argsort(-lengths, kind="stable"):
            fits = [i for i, u in enumerate(used) if u + lengths[piece] <= 100]
            at = fits[0] if fits else len(used)
            if not fits:
                used.append(0)
            assert (sequence[piece], offset[piece]) == (at, used[at])
            used[at] += lengths[piece]


def test_little_room_is_lost():
    lengths = np.random.default_rng(1).integers(1, 2048, packing.GROUP)
    sequence, _ = packing.first_fit_decreasing(lengths)
    assert lengths.sum() > 0.99 * 2048 * (sequence.max() + 1)


def test_groups_are_independent_and_empty_tables_fine(spark):
    df = spark.range(500).selectExpr("id AS doc_id", "repeat('a ', int(id)) AS text")
    pieces = packing.pack(packing.staged(packing.cut(df, PATH), "pieces"), group=40)
    ids = pieces.select("sequence_id").distinct().collect()
    groups = {r[0] // 2 >> 32 for r in ids}
    assert len(groups) > 5 and pieces.count() == 500
    empty = packing.packed(df.limit(0), PATH)
    assert empty.count() == 0 and "offset" in empty.columns
