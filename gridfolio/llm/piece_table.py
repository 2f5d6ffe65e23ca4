"""Token ids of whole texts from the ids of their pieces, found and put together as arrays.

Texts are cut at byte positions where the byte-level pre-tokenizer always cuts, whatever lies around them, so pieces can
be encoded apart. A worker keeps the ids of the pieces it has met in an arena: a hash table of piece numbers, the bytes
of the pieces, and their ids end to end. All pieces of a block of texts are looked up together and compared byte by
byte with what the table holds; only pieces not met before become Python strings and go to the tokenizer.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from gridfolio.llm.common import GOLDEN, mix

#: pieces of more bytes are encoded each time they come
LONG = 64
BLOCK = 4 << 20

_SPACE, _LETTER, _MARK, _QUOTE, _HIGH, _OTHER = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = _MARK
_CLASS[ord("'")] = _QUOTE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[0x80:] = _HIGH
#: whether a piece may begin at a byte, by the classes of the byte before and its own. White space begins one after
#: anything else (after a character beyond ASCII only if that is not white space, see ``cuts``); a mark after a letter; a letter
#: after a mark, but not after an apostrophe, which may belong to it
_CUT = np.zeros((6, 6), bool)
_CUT[[_LETTER, _MARK, _QUOTE, _HIGH, _OTHER], _SPACE] = True
_CUT[_LETTER, [_MARK, _QUOTE]] = True
_CUT[_MARK, _LETTER] = True
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def _wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each position is white space beyond ASCII."""
    last, one, two = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    general = (two == 0xE2) & (((one == 0x80) & ((last <= 0x8A) | np.isin(last, [0xA8, 0xA9, 0xAF]))) | ((one == 0x81) & (last == 0x9F)))
    rare = ((two == 0xE1) & (one == 0x9A) & (last == 0x80)) | ((two == 0xE3) & (one == 0x80) & (last == 0x80))
    return ((one == 0xC2) & ((last == 0x85) | (last == 0xA0))) | general | rare


def cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces begin, in order; every text that is not empty begins one."""
    kinds = _CLASS[data]
    begins = np.zeros(len(data), bool)
    begins[1:] = _CUT[kinds[:-1], kinds[1:]]
    after_high = np.flatnonzero(begins[1:] & (kinds[:-1] == _HIGH)) + 1
    begins[after_high[_wide_space(data, after_high)]] = False
    begins[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
    return np.flatnonzero(begins)


class _Words:
    """Pieces of at most ``LONG`` bytes as numbers of eight bytes: what they are named by and compared by."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        eights = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
        self.length = length
        self.first = eights[start] & _MASKS[np.minimum(length, 8)]
        self.key = mix(self.first + length.astype(np.uint64) * GOLDEN)
        self.rest = np.flatnonzero(length > 8)
        self.place = np.full(len(start), -1, np.int64)
        self.place[self.rest] = np.arange(len(self.rest))
        self.more: list[np.ndarray] = []
        going, at = self.rest, 8
        while len(going):
            eight = eights[start[going] + at] & _MASKS[np.minimum(length[going] - at, 8)]
            self.key[going] = mix(self.key[going] * GOLDEN + eight)
            whole = np.zeros(len(self.rest), np.uint64)
            whole[self.place[going]] = eight
            self.more.append(whole)
            at += 8
            going = going[length[going] > at]


class PieceTable:
    """Ids of pieces, ``encode`` giving (ids, end of each piece's ids) for pieces that are new."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], end_id: int, remembered: int) -> None:
        self.encode, self.remembered = encode, remembered
        self.end_id = end_id
        self.clear()

    def clear(self) -> None:
        """Forget all pieces; changes no result."""
        self.n, self.table = 0, np.full(1 << 16, -1, np.int64)
        self.key, self.first, self.length = (np.empty(1 << 15, t) for t in (np.uint64, np.uint64, np.int64))
        self.more = np.zeros((1 << 15, 0), np.uint64)
        self.ids, self.n_ids = np.empty(1 << 16, np.int32), 0
        self.begin, self.count = (np.empty(1 << 15, np.int64) for _ in range(2))

    def _room(self, n: int, n_ids: int, words: int) -> None:
        def grown(a: np.ndarray, size: int) -> np.ndarray:
            out = np.zeros((max(size, 2 * len(a)), *a.shape[1:]), a.dtype)
            out[: len(a)] = a
            return out

        if self.n + n > len(self.key):
            for name in ("key", "first", "length", "begin", "count", "more"):
                setattr(self, name, grown(getattr(self, name), self.n + n))
        if self.n_ids + n_ids > len(self.ids):
            self.ids = grown(self.ids, self.n_ids + n_ids)
        if self.more.shape[1] < words:
            self.more = np.concatenate([self.more, np.zeros((len(self.more), words - self.more.shape[1]), np.uint64)], axis=1)
        if 2 * (self.n + n) > len(self.table):
            self.table = np.full(1 << int(4 * (self.n + n) - 1).bit_length(), -1, np.int64)
            self._place(np.arange(self.n))

    def _place(self, entries: np.ndarray) -> None:
        """Put distinct entries into the table."""
        slot = (self.key[entries] & np.uint64(len(self.table) - 1)).astype(np.int64)
        while len(entries):
            free = self.table[slot] < 0
            self.table[slot[free]] = entries[free]
            lost = self.table[slot] != entries
            entries, slot = entries[lost], (slot[lost] + 1) & (len(self.table) - 1)

    def _equal(self, words: _Words, i: np.ndarray, entry: np.ndarray) -> np.ndarray:
        same = (words.key[i] == self.key[entry]) & (words.first[i] == self.first[entry]) & (words.length[i] == self.length[entry])
        going = np.flatnonzero(same & (words.length[i] > 8))
        for k, whole in enumerate(words.more):
            going = going[words.length[i[going]] > 8 * (k + 1)]
            if not len(going):
                break
            bad = whole[words.place[i[going]]] != self.more[entry[going], k]
            same[going[bad]] = False
            going = going[~bad]
        return same

    def _find(self, words: _Words, i: np.ndarray) -> np.ndarray:
        """The entry of each piece, -1 for pieces not met before."""
        found = np.full(len(i), -1, np.int64)
        at, slot = np.arange(len(i)), (words.key[i] & np.uint64(len(self.table) - 1)).astype(np.int64)
        while len(at):
            entry = self.table[slot]
            held = entry >= 0
            at, slot, entry = at[held], slot[held], entry[held]
            same = self._equal(words, i[at], entry)
            found[at[same]] = entry[same]
            at, slot = at[~same], (slot[~same] + 1) & (len(self.table) - 1)
        return found

    def _add(self, words: _Words, i: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._room(len(i), len(ids), len(words.more))
        new = np.arange(self.n, self.n + len(i))
        self.key[new], self.first[new], self.length[new] = words.key[i], words.first[i], words.length[i]
        self.more[new] = 0
        far = np.flatnonzero(words.length[i] > 8)
        for k, whole in enumerate(words.more):
            self.more[new[far], k] = whole[words.place[i[far]]]
        starts = np.concatenate([[0], ends[:-1]])
        self.begin[new], self.count[new] = self.n_ids + starts, ends - starts
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n, self.n_ids = self.n + len(i), self.n_ids + len(ids)
        self._place(new)
        return new

    def _entries(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The entry of every piece; new ones are encoded and added."""
        words = _Words(data, start, length)
        if self.n > self.remembered:
            self.clear()
        entry = self._find(words, np.arange(len(start)))
        left = np.flatnonzero(entry < 0)
        while len(left):  # once, unless two new pieces have one key
            some = left[np.sort(np.unique(words.key[left], return_index=True)[1])]
            texts = [data[a : a + n].tobytes().decode("utf-8") for a, n in zip(start[some].tolist(), length[some].tolist(), strict=True)]
            self._add(words, some, *self.encode(texts))
            entry[left] = self._find(words, left)
            left = left[entry[left] < 0]
        return entry

    def encoded(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each text) of the texts between ``bounds``, an end id after each; ``data`` has 8 bytes more."""
        begin = cuts(data[:-8], bounds)
        length = np.diff(np.append(begin, bounds[-1]))
        # a piece ends with its text, also where empty texts follow
        short = np.flatnonzero(length <= LONG)
        far = np.flatnonzero(length > LONG)
        entry = self._entries(data, begin[short], length[short])
        count, place = np.empty(len(begin), np.int64), np.empty(len(begin), np.int64)
        count[short], place[short] = self.count[entry], self.begin[entry]
        pool = self.ids[: self.n_ids]
        if len(far):
            ids, ends = self.encode([data[a : a + n].tobytes().decode("utf-8") for a, n in zip(begin[far].tolist(), length[far].tolist(), strict=True)])
            count[far], place[far] = np.diff(ends, prepend=0), len(pool) + np.concatenate([[0], ends[:-1]])
            pool = np.concatenate([pool, ids.astype(np.int32)])
        # every text's end is one more piece, whose id lies at the end of the pool
        pool = np.append(pool, np.int32(self.end_id))
        until = np.searchsorted(begin, bounds[1:], "left")
        count, place = np.insert(count, until, 1), np.insert(place, until, len(pool) - 1)
        total = np.cumsum(count)
        ids = pool[np.repeat(place - (total - count), count) + np.arange(total[-1])] if len(total) else pool[:0]
        ends = total[until + np.arange(len(until))]
        return ids, np.diff(ends, prepend=0)


def texts_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string array; nulls are empty."""
    wide = pa.types.is_large_string(array.type)
    array = array.fill_null("") if array.null_count else array
    offsets = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    buf = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.empty(0, np.uint8)
    return buf, offsets


def padded(buf: np.ndarray, a: int, b: int) -> np.ndarray:
    out = np.zeros(b - a + 8, np.uint8)
    out[:-8] = buf[a:b]
    return out
