"""Winnowed fingerprints of texts, for containment joins.

A text's pieces are its runs of PIECE bytes. Of every window of consecutive pieces the one with
the least hash is kept. If a text that fills a window stands inside another text, that text has
the same window, and so keeps the same piece. Texts are put into classes by length, since a
window must not be longer than the text; shorter texts than a piece are a piece of their own
length. All the classes of a long text are found in one pass over its bytes.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from meadowlark.functions import bloom

PIECE = 8
WINDOWS = (64, 16, 4, 1)  # powers of two
AT_ONCE = 1 << 20  # bytes of text in one numpy pass


def text_class(text) -> Column:
    """The class of a text as window * 16 + piece; null for empty texts."""
    size = F.octet_length(text)
    found = F.when(size <= 0, F.lit(None))
    for w in WINDOWS:
        found = found.when(size >= PIECE + w - 1, F.lit(w * 16 + PIECE))
    return found.otherwise(16 + size).cast("int")


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _of_class(data: np.ndarray, at: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, fingerprint) of every row for one class, each fingerprint of a row once."""
    window, piece = divmod(kind, 16)
    n = len(data) - piece + 1
    starts = n - window + 1
    if starts < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(piece):
        h |= data[k: k + n].astype(np.uint64) << np.uint64(8 * k)
    with np.errstate(over="ignore"):
        h = _mix(h + np.uint64(kind) * np.uint64(0x9E3779B97F4A7C15))
    step = 1
    while step < window:  # the least of twice as many pieces each time
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[:starts]
    inside = np.arange(starts) + window + piece - 1 <= at[row + 1]
    inside[1:] &= (h[1:] != h[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]  # most windows keep their neighbour's piece
    row, h = row[inside], h[inside]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def _slices(texts: pa.Array):
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if total and total + n > AT_ONCE:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(size):
        yield begin, len(size)


def _lists(texts: pa.Array, rows_of: dict[int, np.ndarray]) -> pa.ListArray:
    """A list of fingerprints for each text; ``rows_of`` names the rows of every class."""
    found = []
    for a, b in _slices(texts):
        part = pc.fill_null(texts[a:b].cast(pa.large_binary()), b"")
        _, offsets, raw = part.buffers()
        ends = np.frombuffer(offsets, np.int64)[part.offset: part.offset + len(part) + 1]
        data = np.frombuffer(raw, np.uint8)[ends[0]: ends[-1]] if raw is not None else np.zeros(0, np.uint8)
        for kind, rows in rows_of.items():
            row, h = _of_class(data, ends - ends[0], kind)
            mine = rows[a:b][row]
            found.append((row[mine] + a, h[mine]))
    return _as_lists(found, len(texts))


def _as_lists(found: list[tuple[np.ndarray, np.ndarray]], n: int) -> pa.ListArray:
    row = np.concatenate([r for r, _ in found] or [np.zeros(0, np.int64)])
    h = np.concatenate([x for _, x in found] or [np.zeros(0, np.uint64)]).view(np.int64)
    order = np.argsort(row, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(h[order]))


def fingerprints(text, kinds: list[int]) -> Column:
    """All fingerprints of a long text for the given classes."""
    @F.arrow_udf(ArrayType(LongType()))
    def of_all(texts: pa.Array) -> pa.Array:
        return _lists(texts, {k: np.ones(len(texts), bool) for k in kinds})

    return of_all.asNondeterministic()(F.col(text))


def own_fingerprints(text, kind) -> Column:
    """The fingerprints of a text for its own class."""
    @F.arrow_udf(ArrayType(LongType()))
    def of_own(texts: pa.Array, kinds: pa.Array) -> pa.Array:
        kinds = pc.fill_null(kinds, 0).to_numpy(zero_copy_only=False)
        return _lists(texts, {int(k): kinds == k for k in np.unique(kinds) if k})

    return of_own.asNondeterministic()(F.col(text), F.col(kind))


def _remainders(texts: pa.Array, keeps: pa.Array, cells: np.ndarray | None = None) -> pa.ListArray:
    alike, found = defaultdict(list), []
    names = texts.to_pylist()
    for i, (name, kept) in enumerate(zip(names, keeps.to_pylist())):
        for keep in kept or ():
            if keep <= len(name):
                alike[len(name), keep].append(i)
    parts = ((size, keep, rows[i: i + n]) for (size, keep), rows in alike.items() for n in [max(1, AT_ONCE // math.comb(size, keep))]
             for i in range(0, len(rows), n))
    for size, keep, rows in parts:
        chars = np.frombuffer("".join(names[i] for i in rows).encode("utf-32-le"), np.uint32).reshape(-1, size).astype(np.uint64)
        left = np.array(list(combinations(range(size), keep)), np.int64)
        h = np.full((len(rows), len(left)), keep, np.uint64)
        for k in range(keep):
            h = h * np.uint64(0x9E3779B97F4A7C15) + chars[:, left[:, k]]
        h = np.sort(_mix(h), axis=1)
        new = np.ones(h.shape, bool)
        new[:, 1:] = h[:, 1:] != h[:, :-1]
        row, h = np.repeat(np.array(rows, np.int64), len(left)).reshape(h.shape)[new], h[new]
        some = slice(None) if cells is None else bloom.maybe(cells, h)
        found.append((row[some], h[some]))
    return _as_lists(found, len(names))


def remainders(text, keeps, held=None) -> Column:
    """Hashes, each once, of what is left of a text when all but ``keep`` characters are taken out, in every way
    and for every ``keep`` of the list; of those only what may be in the filter ``held``, a broadcast one."""
    @F.arrow_udf(ArrayType(LongType()))
    def of_all(texts: pa.Array, kept: pa.Array) -> pa.Array:
        return _remainders(texts, kept, held and held.value)

    return of_all.asNondeterministic()(F.col(text), F.col(keeps))
