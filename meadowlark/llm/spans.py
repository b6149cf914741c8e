"""Token ids of many texts, by looking up the spans into which byte-level tokenizers must cut them.

The split pattern of byte-level BPE vocabularies never joins a letter, digit or mark with a
space after it, nor letters, digits and marks with each other, apostrophes aside. Cutting
texts at such places and tokenizing each span on its own therefore gives the same ids. Spans
are found, hashed and looked up for a whole batch in numpy; only spans that a process has
not met before go through the tokenizer. A hash match also compares length and the first and
last eight bytes, that is all of the up to sixteen bytes of such a span. Longer spans are looked
up by their bytes. So ids never hang on hashes.

A space between other white space, or white space beyond ASCII, would need more context;
texts with either are tokenized whole, and so are texts that hold one of the tokenizer's
special strings.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from meadowlark.llm import words as W

MOST = 300_000  # spans a process remembers before it starts afresh, some 100 bytes each
SHORT = 16  # bytes of the spans that are found by hash
MOST_LONG, LONGEST = 50_000, 256  # longer spans a process remembers, and the bytes of such a one
AT_ONCE = 1 << 16  # spans looked up at a time
PART = 1 << 18  # bytes of text to hand over at once
_LETTER, _DIGIT, _MARK = 1, 2, 3
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[list(range(48, 58))] = _DIGIT
_CLASS[[b for b in b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = _MARK
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _wide_spaces(data: np.ndarray) -> np.ndarray:
    """Where white space beyond ASCII may begin, and separators that only some tools call white space."""
    found = [np.flatnonzero((data >= 0x1C) & (data <= 0x1F))]
    end = np.append(data, np.zeros(2, np.uint8))
    for lead in (0xC2, 0xE1, 0xE2, 0xE3):
        at = np.flatnonzero(data == lead)
        second, third = end[at + 1], end[at + 2]
        if lead == 0xC2:
            hit = (second == 0x85) | (second == 0xA0)
        elif lead == 0xE1:
            hit = ((second == 0x9A) & (third == 0x80)) | ((second == 0xA0) & (third == 0x8E))
        elif lead == 0xE2:
            hit = ((second == 0x80) & ((third <= 0x8B) | ((third >= 0xA8) & (third <= 0xAF)))) | ((second == 0x81) & (third >= 0x9F))
        else:
            hit = (second == 0x80) & (third == 0x80)
        found.append(at[hit])
    return np.concatenate(found)


def cut(data: np.ndarray, at: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Where spans begin. Rows that must stay whole, and those that ``kept`` marks, have their start only."""
    n, whole = len(data), kept.copy()
    rows = at[:-1][at[1:] > at[:-1]]
    if not n:
        return rows
    space, blank, kind = data == 0x20, _SPACE[data], _CLASS[data]
    first = np.zeros(n + 1, bool)
    first[at] = True
    start = space.copy()
    start[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    start[1:] |= (data[1:] == 0x0A) & (kind[:-1] > 0)
    before, after = np.zeros(n, bool), np.ones(n, bool)
    before[1:] = blank[:-1] & ~first[1:n]
    after[:-1] = blank[1:]
    after |= first[1:]
    odd = np.concatenate([np.flatnonzero(space & before & after), _wide_spaces(data)])
    whole[np.searchsorted(at, odd, "right") - 1] = True
    if whole.any():
        for r in np.flatnonzero(whole):
            start[at[r]: at[r + 1]] = False
    start[rows] = True
    return np.flatnonzero(start)


def _ends(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last eight bytes of each span as numbers, shorter spans padded."""
    size = end - begin
    head, tail = np.zeros(len(begin), np.uint64), np.zeros(len(begin), np.uint64)
    for k in range(8):
        has = np.flatnonzero(size > k)
        if not len(has):
            break
        head[has] |= data[begin[has] + k].astype(np.uint64) << np.uint64(8 * k)
        tail[has] |= data[end[has] - 1 - k].astype(np.uint64) << np.uint64(8 * k)
    return head, tail


Coded = tuple[np.ndarray, np.ndarray, np.ndarray]  # ids, and where each string's ids start and how many they are


def coded(ids: list[np.ndarray]) -> Coded:
    """The ids of some strings, one after the other."""
    count = np.array([len(x) for x in ids], np.int64)
    return np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.uint32), np.cumsum(count) - count, count


class SpanCache:
    """``encode`` gives the ids of strings, each tokenized on its own. Texts that hold a string of
    ``special`` are not cut."""

    def __init__(self, encode: Callable[[list[str]], Coded], most: int = MOST, special: tuple[str, ...] = ()):
        self.encode, self.most, self.special = encode, most, special
        self.long: dict[bytes, bytes] = {}
        self.bits = (most + most // 2).bit_length()
        self._clear()

    def _clear(self) -> None:
        size = 1 << self.bits
        self.key, self.head, self.tail = (np.zeros(size, np.uint64) for _ in range(3))
        self.size, self.start, self.count = (np.zeros(size, np.int32) for _ in range(3))
        self.held, self.used, self.ids = 0, 0, np.zeros(1 << 16, np.uint32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Slots of the keys, -1 for those not there."""
        out, todo = np.full(len(h), -1), np.arange(len(h))
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            at = slot[todo]
            key = self.key[at]
            hit = key == h[todo]
            out[todo[hit]] = at[hit]
            todo = todo[~hit & (key != 0)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def _insert(self, h, head, tail, size, ids: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
        total = len(ids)
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(total, 2 * len(self.ids)), np.uint32)])
        self.ids[self.used: self.used + total] = ids
        start = self.used + start
        self.used, self.held = self.used + total, self.held + len(h)
        slot, todo = (h >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(h))
        while len(todo):  # of the keys that want a free slot one gets it
            at = slot[todo]
            free = self.key[at] == 0
            self.key[at[free]] = h[todo[free]]
            won = free & (self.key[at] == h[todo])
            at, who = at[won], todo[won]
            self.head[at], self.tail[at], self.size[at], self.start[at], self.count[at] = head[who], tail[who], size[who], start[who], count[who]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _spans(self, data, begin, end) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some spans of at most SHORT bytes, and how many each has."""
        h = np.maximum(W.span_hashes(data, begin, end), np.uint64(1))
        head, tail = _ends(data, begin, end)
        size = (end - begin).astype(np.int32)
        slot = self._find(h)
        new, one = np.unique(h[slot < 0], return_index=True)
        if len(new):
            if self.held + len(new) > self.most:
                self._clear()
                slot[:] = -1
                new, one = np.unique(h, return_index=True)
            at = np.flatnonzero(slot < 0)[one]
            raw = data.tobytes() if len(at) > 1000 else None
            texts = [(raw[a:b] if raw is not None else data[a:b].tobytes()).decode() for a, b in zip(begin[at].tolist(), end[at].tolist())]
            self._insert(h[at], head[at], tail[at], size[at], *self.encode(texts))
            slot = self._find(h)
        count, start, ids = self.count[slot].astype(np.int64), self.start[slot].astype(np.int64), self.ids
        other = np.flatnonzero((self.head[slot] != head) | (self.tail[slot] != tail) | (self.size[slot] != size))
        if len(other):  # spans of equal hash, tokenized on their own
            own, at, count[other] = self.encode([data[begin[i]: end[i]].tobytes().decode() for i in other])
            start[other] = self.used + at
            ids = np.concatenate([self.ids[: self.used], own])
        stop = np.cumsum(count)
        total = int(stop[-1]) if len(stop) else 0
        return ids[np.repeat(start - (stop - count), count) + np.arange(total)], count

    def _named(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of longer strings, found by their bytes, and how many each has."""
        if len(self.long) > MOST_LONG:
            self.long = {}
        known = {r: self.long[r] for r in raws if r in self.long}
        new = [r for r in dict.fromkeys(raws) if r not in known]
        if new:
            ids, start, count = self.encode([r.decode() for r in new])
            for r, a, n in zip(new, start.tolist(), count.tolist()):
                known[r] = ids[a: a + n].astype(np.uint32).tobytes()
                if len(r) <= LONGEST:
                    self.long[r] = known[r]
        found = [known[r] for r in raws]
        return np.frombuffer(b"".join(found), np.uint32), np.array([len(x) // 4 for x in found], np.int64)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows one after the other, and the n + 1 offsets of the rows; null counts as empty."""
        data, at = W.utf8(texts)
        kept = np.zeros(len(texts), bool)
        for s in self.special:
            kept |= pc.fill_null(pc.match_substring(texts, s), False).to_numpy(zero_copy_only=False)
        begin = cut(data, at, kept)
        end = np.append(begin[1:], len(data))
        ids, counts = [], []
        for a in range(0, len(begin), AT_ONCE):
            got, count = self._mixed(data, begin[a: a + AT_ONCE], end[a: a + AT_ONCE])
            ids.append(got)
            counts.append(count)
        count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(count)])
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), total[np.searchsorted(begin, at)]

    def _mixed(self, data, begin, end):
        long = end - begin > SHORT
        if not long.any():
            return self._spans(data, begin, end)
        got, some = self._spans(data, begin[~long], end[~long])
        raw, base = data[begin[0]: end[-1]].tobytes(), int(begin[0])
        rows, own = self._named([raw[a:b] for a, b in zip((begin[long] - base).tolist(), (end[long] - base).tolist())])
        count = np.zeros(len(begin), np.int64)
        count[~long], count[long] = some, own
        out = np.empty(int(count.sum()), np.uint32)
        mine = np.repeat(long, count)
        out[~mine], out[mine] = got, rows
        return out, count
