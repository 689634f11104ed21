"""Token ids by a public tokenizer; each distinct word is encoded once and then found by its hash.

Words are what lies between ASCII white space. A tokenizer that drops white space and never joins what it parts
gives a text the ids of its words, one after another, so a worker keeps a table from 64-bit word hashes to ids
and looks up all words of a group of texts at once. The table has a fixed size and starts anew when it is full.
Other tokenizers get whole texts.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from quern.llm.common import PLAIN, buffer, pieces, word_hashes, words

#: Places in the table, words and ids in it at most.
PLACES, WORDS, IDS = 1 << 20, 600_000, 3_000_000
DEFAULT = "word_bpe_49k.json"

#: How a tokenizer must prepare text for words to be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

#: Words of printable ASCII and precomposed Latin letters: lower-casing goes letter by letter and NFC changes nothing.
_LETTERS = "ß-öø-įı-ňŊ-ž"
_PLAIN = re.compile(rf"[\x21-\x7eÀ-ÖØ-Þ{_LETTERS}]+")
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LETTERS}]+|[0-9]|[^\sa-z0-9{_LETTERS}]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The letter that byte-level models have for each byte.
_BYTE_LETTERS = dict(zip([*_SHOWN, *(b for b in range(256) if b not in _SHOWN)], [*map(chr, _SHOWN), *map(chr, range(256, 512))]))


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        how = json.loads(self.tokenizer.to_str())
        added = how["added_tokens"]
        self.by_word = how["normalizer"] == NORMALIZER and how["pre_tokenizer"] == PRE_TOKENIZER and not any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in added)
        self.added = [x["content"] for x in added]
        self.model = self.tokenizer.model
        self.table: tuple[np.ndarray, ...] | None = None

    def word(self, word: str) -> list[int]:
        if (word.isascii() and word.isprintable() or _PLAIN.fullmatch(word)) and not ("<" in word and any(x in word for x in self.added)):
            out = []
            for piece in _PIECES.findall(word.lower()):
                out += [t.id for t in self.model.tokenize(piece if piece.isascii() else "".join(map(_BYTE_LETTERS.__getitem__, piece.encode())))]
            return out
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def forget(self) -> None:
        self.table = None

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or the complement of the free place at which the search ended."""
        keys = self.table[0]
        place = (h >> np.uint64(64 - PLACES.bit_length() + 1)).astype(np.int64)
        open_ = np.arange(len(h))
        while len(open_):
            at = place[open_]
            there = keys[at]
            free = open_[there == 0]
            place[free] = ~place[free]
            open_ = open_[(there != 0) & (there != h[open_])]
            place[open_] = (place[open_] + 1) & (PLACES - 1)
        return place

    def _places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each word; new words are encoded and put in."""
        h = word_hashes(data, starts, ends, PLAIN) | np.uint64(1)  # 0 marks a free place
        if self.table is None or self.known > WORDS or self.used > IDS:
            self.table = (np.zeros(PLACES, np.uint64), np.zeros(PLACES, np.uint32), np.zeros(PLACES, np.uint32), np.zeros(1 << 16, np.uint32))
            self.known = self.used = 0
        place = self._find(h)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new, first = np.unique(h[missing], return_index=True)
            first = missing[first]
            raw = data.tobytes()
            ids = [self.word(raw[a:b].decode()) for a, b in zip(starts[first].tolist(), ends[first].tolist())]
            counts = np.fromiter(map(len, ids), np.uint32, len(ids))
            flat = np.array([x for own in ids for x in own], np.uint32)
            keys, begin, count, pool = self.table
            if self.used + len(flat) > len(pool):
                pool = np.concatenate([pool, np.zeros(max(len(pool), len(flat)), np.uint32)])
                self.table = (keys, begin, count, pool)
            pool[self.used : self.used + len(flat)] = flat
            at = (self.used + np.cumsum(counts, dtype=np.int64) - counts).astype(np.uint32)
            self.used += len(flat)
            self.known += len(new)
            left = np.arange(len(new))
            while len(left):  # of several words that want one place one gets it
                free = ~self._find(new[left])
                free, own = np.unique(free, return_index=True)
                put = left[own]
                keys[free], begin[free], count[free] = new[put], at[put], counts[put]
                rest = np.ones(len(left), bool)
                rest[own] = False
                left = left[rest]
            place = self._find(h)
        return place

    def encoded(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For groups of neighbouring texts all their ids (32 bits), and how many each text has."""
        data, offsets = buffer(column)
        for part, at in self._groups(data, offsets):
            if not self.by_word:
                ids = [self.tokenizer.encode(part[a:b].tobytes().decode(), add_special_tokens=False).ids for a, b in zip(at[:-1], at[1:])]
                yield np.array([x for own in ids for x in own], np.uint32), np.array([len(x) for x in ids], np.int64)
                continue
            starts, ends, begins = words(part, at, PLAIN)
            place = self._places(part, starts, ends)
            _, begin, count, pool = self.table
            n = count[place].astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(n)])
            yield pool[np.repeat(begin[place].astype(np.int64) - sums[:-1], n) + np.arange(sums[-1])], np.diff(sums[begins])

    def lengths(self, column: pa.Array) -> Iterator[np.ndarray]:
        """For groups of neighbouring texts how many ids each has."""
        data, offsets = buffer(column)
        if not self.by_word:
            yield from (n for _, n in self.encoded(column))
            return
        for part, at in self._groups(data, offsets):
            starts, ends, begins = words(part, at, PLAIN)
            place = self._places(part, starts, ends)
            sums = np.concatenate([[0], np.cumsum(self.table[2][place], dtype=np.int64)])
            yield np.diff(sums[begins])

    @staticmethod
    def _groups(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for lo, hi in pieces(offsets):
            yield data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]

    def ids(self, text: str) -> list[int]:
        return next(self.encoded(pa.array([text])))[0].tolist()


@functools.cache
def encoder(path: str = "") -> Encoder:
    return Encoder(path or public_tokenizers.path(DEFAULT))
