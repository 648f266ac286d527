"""Ids of a lower-casing word BPE, fast: texts become word pieces, and each distinct piece is encoded once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from parchment.llm.common import byte_codes, span_hashes

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
JOINED = 4096


def byte_classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of ASCII bytes, and of the second bytes after 0xC2 and 0xC3 (U+0080 to U+00FF)."""
    one, c2, c3 = (np.full(256, OTHER, np.uint8) for _ in range(3))
    for byte in range(128):
        c = chr(byte)
        one[byte] = SPACE if c in " \t\n\v\f\r" else LETTER if c.isalpha() else DIGIT if c.isdigit() else OTHER
    for byte in range(0x80, 0xC0):
        for table, lead in ((c2, 0x80), (c3, 0xC0)):
            c = chr(lead + (byte & 0x3F))
            table[byte] = SPACE if c in "\x85\xa0" else LETTER if c.isalpha() else DIGIT if c.isnumeric() else OTHER
    return one, c2, c3


class WordBpe:
    """Ids as the tokenizers library gives them.

    Texts of ASCII and U+0080 to U+00FF characters are cut into pieces by vectorised rules that
    say the same as the tokenizer's own pattern over such characters; each distinct piece goes
    through the library once and is then looked up. All other texts, and those that name a
    special token, go through the library whole. The table of pieces is emptied at `most` entries.
    """

    def __init__(self, name: str, most: int = 1 << 20):
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.most = most
        self.one, self.c2, self.c3 = byte_classes()
        self.low = np.arange(256, dtype=np.uint8)
        self.low[65:91] += 32
        self.codes = byte_codes(61)
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for word, i in words.items() if word.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def plain(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows that the vectorised rules cover: no lead byte above 0xC3, no text of a special token."""
        bad = np.flatnonzero((data >= 0xC4) | (data == 0x7C) & (np.roll(data, 1) == 0x3C))
        rows = np.ones(len(at) - 1, bool)
        rows[np.searchsorted(at, bad, "right") - 1] = False
        return rows

    def pieces(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes, and the start and end of each piece."""
        tail = data & 0xC0 == 0x80
        lead = np.empty_like(data)
        lead[:1], lead[1:] = 0, data[:-1]
        kind = self.one[data]
        second = np.flatnonzero(tail)
        kind[second] = np.where(lead[second] == 0xC3, self.c3[data[second]], self.c2[data[second]])
        kind[second - 1] = kind[second]
        data = self.low[data]
        upper = second[(lead[second] == 0xC3) & (data[second] <= 0x9E) & (data[second] != 0x97)]
        data[upper] += 0x20
        new = np.ones(len(data) + 1, bool)
        new[1:-1] = kind[1:] != kind[:-1]
        new[:-1] |= kind == DIGIT
        new[at[:-1][at[:-1] < len(data)]] = True
        new[:-1] &= ~tail
        # A mark ' that starts a piece takes s, t, m, d, re, ve or ll with it.
        marks = np.flatnonzero((data == 0x27) & new[:-1])
        if len(marks):
            row_end = at[np.searchsorted(at, marks, "right")]
            padded = np.concatenate([data, np.zeros(3, np.uint8)])
            x, y = padded[marks + 1], padded[marks + 2]
            x = np.where(marks + 1 < row_end, x, 0)
            y = np.where(marks + 2 < row_end, y, 0)
            one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
            two = (x == 0x72) & (y == 0x65) | (x == 0x76) & (y == 0x65) | (x == 0x6C) & (y == 0x6C)
            new[marks[one | two] + 1] = False
            new[marks[one] + 2] = True
            new[marks[two] + 3] = True
        start = np.flatnonzero(new[:-1])
        end = np.append(start[1:], len(data)) if len(start) else start
        held = kind[start] != SPACE
        return data, start[held], end[held]

    def learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        """Encode pieces with a space between them; a piece ends with the one id whose token ends a word."""
        size = end - start
        till = np.cumsum(size + 1)
        text = np.full(till[-1], 0x20, np.uint8)
        text[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = data[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]
        cuts = [0, *till[np.searchsorted(till, np.arange(JOINED, till[-1], JOINED))], till[-1]]
        texts = [text[a:b].tobytes().decode() for a, b in zip(cuts, cuts[1:])]
        ids = np.array([i for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) for i in x.ids], np.uint32)
        count = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(count) != len(start):
            raise ValueError("the tokenizer cut pieces of text differently")
        first = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, ids])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.first = np.concatenate([self.first, first])[order]
        self.count = np.concatenate([self.count, count])[order]

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.known, hashes)
        i[i == len(self.known)] = 0
        return i, self.known[i] == hashes if len(self.known) else np.zeros(len(hashes), bool)

    def encode(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Ids of each row."""
        plain = self.plain(data, at)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(plain)
        other = np.flatnonzero(~plain)
        if len(other):
            texts = [data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace") for i in other]
            for i, x in zip(other, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                out[i] = np.array(x.ids, np.uint32)
            data = np.concatenate([data[at[i] : at[i + 1]] for i in np.flatnonzero(plain)] or [data[:0]])
            at = np.concatenate([[0], np.cumsum(np.diff(at)[plain])])
        if not len(data):
            return out
        data, start, end = self.pieces(data, at)
        hashes = span_hashes(data, start, end, self.codes)
        words, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self.clear()
        _, found = self.look_up(words)
        if not found.all():
            new = where[~found]
            self.learn(data, start[new], end[new], words[~found])
        entry, _ = self.look_up(words)
        count = self.count[entry][which]
        till = np.cumsum(count)
        ids = self.ids[np.repeat(self.first[entry][which] - till + count, count) + np.arange(till[-1] if len(till) else 0)]
        till = np.concatenate([[0], till])
        cuts = till[np.searchsorted(start, at)]
        for row, i in enumerate(np.flatnonzero(plain)):
            out[i] = ids[cuts[row] : cuts[row + 1]]
        return out


@lru_cache(maxsize=2)
def word_bpe(name: str) -> WordBpe:
    return WordBpe(name)
