"""Agenda encoding against the sentencepiece library, and the way back."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from corvane.llm.pieces import PieceEncoder, encoded

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None,
    "",
    " ",
    "   ",
    "▁",
    "a▁b ▁",
    " lead and trail  ",
    "\x00a\x01\n\n\t\r x\x85y z",
    "é É é 漢字かな 🙂🙂👩‍👩 �﻿ \U0010ffff",
    "<s> </s> <unk> <0x41> a<s>b",
    "1234567 12 3.14 don't... !!!???  ####  ====",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    " " * 100 + "x" + " " * 17,
]


@pytest.fixture(scope="module")
def encoder():
    return PieceEncoder(open(PATH, "rb").read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def whole(encoder, text, size=1 << 16):
    found = [u for units in encoder.blocks(text or "", size) for u in units]
    assert all(u.agrees for u in found)
    ids = [int(i) for u in found for i in u.decimal.split(b",")]
    return ids, "".join(u.decoded for u in found)[1:]


def drawn(seed, count=400):
    draw = random.Random(seed)
    signs = "aeinrst  ▁.,'-\n\tABC123éß漢🙂\x00"
    words = ["the", "ing", " and", "tion", "  ", " un", "ß", "\n\n", "http://", "...", "日本"]
    for _ in range(count):
        yield "".join(draw.choice(signs) if draw.random() < 0.5 else draw.choice(words) for _ in range(draw.randint(1, 60)))


@pytest.mark.parametrize("size", [1 << 16, 5])
def test_ids_and_text_are_the_librarys(encoder, library, size):
    for text in [*ODD, *drawn(size)]:
        ids, decoded = whole(encoder, text, size)
        assert ids == library.encode(text or "")
        assert decoded == library.decode(ids) == encoder.decode(ids)


def test_a_whole_text_as_one_unit(encoder, library):
    for text in drawn(3, 100):
        assert encoder.ids("▁" + text.replace(" ", "▁")) == library.encode(text)


def test_any_ids_decode_as_in_the_library(encoder, library):
    draw = random.Random(5)
    for _ in range(500):
        pool = [0, 1, 2, *draw.choices(range(3, 259), k=6), *draw.choices(range(259, 32000), k=4), 28705, 264]
        ids = draw.choices(pool, k=draw.randint(0, 12))
        assert encoder.decode(ids) == library.decode(ids), ids


def test_a_long_text_without_spaces(encoder, library):
    text = "".join(random.Random(1).choices("abcdefghijklmnopqrst", k=200_000))
    ids, decoded = whole(encoder, text)
    assert ids == library.encode(text) and decoded == text


def test_table(spark, library):
    rows = [(i, t, "x", "y") for i, t in enumerate([*ODD, "word " * 50_000])]
    rows += [rows[6], (None, "no id", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, agrees string")
    got = encoded(df, PATH, with_ids=True).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        ids = library.encode(texts[r["doc_id"]] or "")
        assert r["agrees"] and r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded"] == library.decode(ids)
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert encoded(df.limit(0), PATH).collect() == []


def test_other_kinds_of_model_are_refused():
    proto = sentencepiece_model_pb2.ModelProto.FromString(open(PATH, "rb").read())
    proto.trainer_spec.model_type = 1
    with pytest.raises(ValueError):
        PieceEncoder(proto.SerializeToString())


def test_a_difference_from_the_library_is_told(encoder, monkeypatch):
    other = PieceEncoder(open(PATH, "rb").read())
    monkeypatch.delitem(other.ranks, "▁then")
    names = "so then, all is well".replace(",", " ,").split()
    found = [u.agrees for units in other.blocks("so then, all is well") for u in units]
    assert dict(zip(names, found)) == {n: n != "then" for n in names}
