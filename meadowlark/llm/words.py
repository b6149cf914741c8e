"""Word and line hashes of many texts at once, as numpy passes over their UTF-8 bytes.

Words are the runs ``[^\\x20\\x09-\\x0D]+``. All separators are ASCII, so bytes can be
split without decoding. A hash is the sum, mixed, of one pseudo-random 64-bit number for every
byte and its place in the word (tabulation hashing); hashes are the same in every process, which
Python's own string hashes are not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from meadowlark.llm.batches import process_cache

SEGMENT = 1 << 20  # bytes of text in one numpy pass
HASHED = 1 << 18  # bytes hashed at once
NEAR = 64  # places in a word whose values are tabled
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch of texts and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    if data is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]: at[-1]], at - at[0]


def slices(texts: pa.Array, most: int = SEGMENT):
    """Row ranges (from, to) of about ``most`` bytes of text; a longer text stands alone."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, n in enumerate(size):
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += int(n)
    if begin < len(size):
        yield begin, len(size)


def _value(place_and_byte: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(place_and_byte.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)))


def _near() -> np.ndarray:
    held = process_cache()
    if "near" not in held:
        held["near"] = _value(np.arange(NEAR * 256))
    return held["near"]


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every byte span; spans are disjoint and ascending. A pass takes spans of up to
    HASHED bytes together; a longer span takes what it needs."""
    out = np.empty(len(begin), np.uint64)
    table = _near()
    i = 0
    with np.errstate(over="ignore"):
        while i < len(begin):
            base = begin[i]
            j = max(i + 1, int(np.searchsorted(end, base + HASHED, "right")))
            n = int(end[j - 1] - base)
            a, b = (begin[i:j] - base).astype(np.int32), (end[i:j] - base).astype(np.int32)
            place = np.arange(n, dtype=np.int32)
            place -= np.repeat(a, np.diff(a, append=np.int32(n)))
            far = np.flatnonzero(place >= NEAR)
            if len(far):
                late = _value(place[far].astype(np.int64) * 256 + data[base: base + n][far])
                place[far] = 0
            place *= 256
            place += data[base: base + n]
            total = np.zeros(n + 1, np.uint64)
            values = table[place]
            if len(far):
                values[far] = late
            np.cumsum(values, out=total[1:])
            out[i:j] = total[b] - total[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            i = j
    return mix(out)


def word_spans(data: np.ndarray, at: np.ndarray, word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n + 1 word offsets of the rows. ``word`` tells
    for every byte whether it belongs to a word, if words are other runs than the usual."""
    word = ~_SPACE[data] if word is None else word
    if not len(word):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edge = np.unique(at[(at > 0) & (at < len(data))])  # a row ends a word
    first[edge] = word[edge]
    last[edge - 1] = word[edge - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, at)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the n + 1 word offsets of the rows."""
    begin, end, offsets = word_spans(data, at)
    return span_hashes(data, begin, end), offsets


_WINDOW = [np.uint64(x | 1) for x in (0x9FB21C651E98DF25, 0xD1342543DE82EF95, 0xA0761D6478BD642F,
                                     0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def windows(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n <= 5 words inside one row, and the position of each one's first word."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = words[: len(words) - n + 1] * _WINDOW[0]
        for k in range(1, n):
            h += words[k: len(words) - n + 1 + k] * _WINDOW[k]
    ok = np.ones(len(h), bool)
    for k in range(1, n):  # a window must not reach over the end of its row
        cut = offsets[1:-1] - k
        ok[cut[(cut >= 0) & (cut < len(h))]] = False
    at = np.flatnonzero(ok)
    return mix(h[at]), at


def per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set between each pair of offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def repeated(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each hash, whether its row holds it twice or more."""
    with np.errstate(over="ignore"):
        key = mix(h + rows.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    out = np.empty(len(h), bool)
    out[order] = same[1:] | same[:-1]
    return out
