"""Token ids of whole texts, each different chunk and word encoded once per task.

A tokenizer whose normalizer and pre-tokenizer never look across white space
gives a text the ids of its white-space separated chunks, one after the other.
So a task keeps the ids of the chunks it has met, as little-endian bytes, and
joins them. New chunks of the common form, letters and then punctuation, are
two units for the tokenizer; its model is asked for each different unit once.
All other chunks go through the whole tokenizer.
"""

from __future__ import annotations

import json
import re
from struct import pack

from tokenizers import Tokenizer, pre_tokenizers

from corvane.llm.texts import word_blocks

KNOWN = 300_000  # chunks, and units, that a task holds; they are dropped beyond that
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäæçèéêëìíîïñòóôöùúûüÿßœ"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
COMMON = re.compile(f"([{LETTERS}]*)([{re.escape(MARKS)}]*)")


def _folds_case(definition: str) -> bool:
    """Whether texts are lower-cased, split into letters and other signs, and mapped by bytes."""
    parts = json.loads(definition)
    normal = [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])]
    before = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
    letters_apart = any(r"[\p{L}]+" in x.get("pattern", {}).get("Regex", "") for x in before)
    return normal == ["NFC", "Replace", "Lowercase"] and letters_apart and before[-1]["type"] == "ByteLevel"


class _Known(dict):
    """Ids of chunks, worked out when first asked for."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self[chunk] = self.learn(chunk)
        return ids


class ChunkEncoder:
    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        self.known = _Known(self._chunk)
        self.units = _Known(self._unit)
        self.model = self.tokenizer.model if _folds_case(definition) else None
        signs = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = {ord(c): signs.pre_tokenize_str(c)[0][0] for c in LETTERS + MARKS}

    def _unit(self, unit: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(unit.translate(self.signs))] if unit else []
        return pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if self.model and (common := COMMON.fullmatch(text.lower())):
            return self.units[common[1]] + self.units[common[2]]
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: bytes) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit numbers."""
        for held in (self.known, self.units):
            if len(held) > KNOWN:
                held.clear()
        find = self.known.__getitem__
        return b"".join([b"".join(map(find, block.split())) for block in word_blocks(text)])
