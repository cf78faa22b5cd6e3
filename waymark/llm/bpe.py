"""Ids of the ``tokenizers`` library for many texts at once, each distinct piece encoded once.

A byte-level BPE file splits a text into pieces before it merges: letters, digits or other marks, each
perhaps after one blank, and white space. So a text may be cut wherever the kind of character changes
(but after a blank, several white space characters or an apostrophe): the ids of the parts, one after another, are the ids of the
text. Parts repeat, and those that were seen are looked up by their text; the rest goes to the
library in batches. Cuts are made between ASCII characters, and before white space; where a file's added
tokens have two such characters side by side, not between these. A file whose rules do not promise
all this (a normalizer, another pre-tokenizer, added tokens that take blanks) has its texts encoded
whole. The choice depends on the file alone, never on a text.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import textnum

#: Bytes that are cut up together, and the longest stretch of one text that is worked on at once if it may be cut.
WINDOW = 2_000_000
#: Stretches that are remembered, some 150 bytes each, and the longest that is.
KNOWN, KNOWN_CHARS = 500_000, 50
#: First bytes of characters beyond ASCII that are no white space, whatever follows.
_GRAPHIC = np.zeros(256, dtype=bool)
_GRAPHIC[[*range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True
_LETTER, _DIGIT, _MARK, _SPACE = 1, 2, 3, 4


def may_cut(spec: dict) -> bool:
    """Whether a tokenizer file promises that texts may be cut between pieces."""
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])) for t in spec["added_tokens"])
    byte_level = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    return bool(plain and byte_level and model["type"] == "BPE" and not model.get("dropout") and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding"))


def pairs(spec: dict) -> np.ndarray:
    """For each two ASCII bytes side by side, as first * 256 + second, whether a text may be cut between them."""
    kind = np.zeros(256, dtype=np.uint8)
    for byte in range(0x21, 0x7F):
        kind[byte] = _LETTER if chr(byte).isalpha() else _DIGIT if chr(byte).isdigit() else _MARK
    kind[[9, 10, 11, 12, 13, 32]] = _SPACE
    out = (kind[:, None] != kind[None, :]) & (kind[:, None] > 0) & (kind[None, :] > 0)
    out[32, :] = False  # a blank belongs to what follows
    out[ord("'"), kind == _LETTER] = False
    for token in spec["added_tokens"]:
        raw = token["content"].encode()
        out[list(raw[:-1]), list(raw[1:])] = False
    return out.reshape(-1)


def cuts(data: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Where UTF-8 bytes may be cut, in no order."""
    if len(data) < 2:
        return np.empty(0, dtype=np.int64)
    plain = np.flatnonzero(pairs[data[:-1].astype(np.uint16) << 8 | data[1:]]) + 1
    # where several white space characters end, what follows them decides how they are cut
    after = data[plain - 1]
    before = data[np.maximum(plain - 2, 0)]
    plain = plain[(after > 32) | ((before > 32) & (before < 0x7F))]
    far = np.flatnonzero((data[:-1] >= 0x80) & ((data[1:] == 32) | (data[1:] == 10))) + 1
    back = [data[np.maximum(far - k, 0)] for k in (2, 3, 4)]
    first = np.where(back[0] >= 0xC0, back[0], np.where(back[1] >= 0xC0, back[1], back[2]))
    return np.concatenate([plain, far[_GRAPHIC[first]]])


def _windows(data: np.ndarray, offsets: np.ndarray, pairs: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) again, with a long text in several windows of one row each."""
    at = 0
    while pairs is not None and len(offsets) == 2 and len(data) - at > 2 * WINDOW:
        reach, found = WINDOW, np.empty(0, dtype=np.int64)
        while not len(found) and at + reach < len(data):  # farther, until it may be cut
            reach *= 2
            found = np.sort(cuts(data[at : at + reach], pairs))
        if not len(found):
            break
        end = at + int(found[min(np.searchsorted(found, WINDOW), len(found) - 1)])
        yield 0, data[at:end], np.array([0, end - at])
        at = end
    yield 0, data[at:], offsets - offsets[0] if not at else np.array([0, len(data) - at])


class BatchEncoder:
    """Encodes texts by the tokenizer file at ``path``; one instance a Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._pairs = pairs(spec) if may_cut(spec) else None
        narrow = max(self._library.get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16
        self.dtype, self._code = np.dtype(np.uint16 if narrow else np.uint32), "H" if narrow else "I"
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a string column, one after another without special tokens added, and how many each has."""
        counts, ids = np.zeros(len(texts), dtype=np.int64), [np.empty(0, dtype=self.dtype)]
        for row, data, offsets in textnum.blocks(texts, WINDOW):
            for first, part, bounds in _windows(data, offsets, self._pairs):
                found, each = self._window(part, bounds)
                ids.append(found)
                counts[row + first : row + first + len(each)] += each
        return np.concatenate(ids), counts

    def _window(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        if self._pairs is not None:
            edge[cuts(data, self._pairs)] = True
        at = np.flatnonzero(edge)
        stretches = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        if not len(stretches):
            return np.empty(0, dtype=self.dtype), np.zeros(len(offsets) - 1, dtype=np.int64)
        distinct = stretches.dictionary_encode()
        which = distinct.indices.to_numpy()
        found = self._ids(distinct.dictionary.to_pylist())
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(found), dtype=self.dtype)
        each = lengths[which]
        upto = np.cumsum(each)
        origin = np.cumsum(lengths) - lengths
        index = np.repeat(origin[which] - (upto - each), each) + np.arange(upto[-1])
        ends = np.concatenate([[0], upto])[np.searchsorted(at, offsets)]
        return flat[index], np.diff(ends)

    def _ids(self, stretches: list[str]) -> list[bytes]:
        """The ids of distinct stretches as bytes of ``dtype``."""
        if len(self._known) > KNOWN // 2:
            self._known, self._older = {}, self._known  # what is not met again goes at the next turn
        out = list(map(self._known.get, stretches))
        new = []
        for k in [k for k, ids in enumerate(out) if ids is None]:
            out[k] = self._older.get(stretches[k])
            if out[k] is None:
                new.append(k)
            elif len(stretches[k]) <= KNOWN_CHARS:
                self._known[stretches[k]] = out[k]
        encoded = self._library.encode_batch_fast([stretches[k] for k in new], add_special_tokens=False)
        for k, e in zip(new, encoded, strict=True):
            out[k] = array(self._code, e.ids).tobytes()
            if len(stretches[k]) <= KNOWN_CHARS:
                self._known[stretches[k]] = out[k]
        return out
