"""Byte-level BPE encoding and decoding with numpy matrices.

Distinct pieces of a batch are put into matrices by length, one row each, padded. In each
round every row merges its leftmost pair of lowest rank: all pairs are looked up in one
open-addressing hash table, the merged id replaces the pair, the row closes the gap, and
rows without a pair leave the matrix. Pieces above LONG bytes would take a round per
merge over a wide row; they are merged one by one with a heap, to the same ids.

Defined results: null and empty texts have no ids; null id lists decode to no bytes; an id
outside the vocabulary is an error. Special tokens in a text are ordinary text. Repeated
rows, ties and extra columns pass through; a column named as a result is replaced.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from meadowlark.llm import words as W
from meadowlark.llm.batches import bound_batches, free_name, process_cache
from meadowlark.llm.spans import PART, Coded, SpanCache

_NONE = np.int32(2**31 - 1)
_EMPTY = np.uint64(2**64 - 1)
_WIDTHS = (4, 8, 16, 32, 64, 128)
LONG = _WIDTHS[-1]
CELLS = 1 << 18  # of a matrix


class PairTable:
    """(left id, right id) -> id of the merged bytes, by open addressing."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        keys, values = np.array(keys, np.uint64), np.array(values, np.int32)
        self.bits = max(4, int(2 * max(1, len(keys))).bit_length())
        self.keys = np.full(1 << self.bits, _EMPTY)
        self.values = np.full(1 << self.bits, _NONE)
        slot, left = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):  # of the keys that want a free slot, one gets it; the others try the next slot
            at = slot[left]
            free = self.keys[at] == _EMPTY
            self.keys[at[free]] = keys[left[free]]
            won = free & (self.keys[at] == keys[left])
            self.values[at[won]] = values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where it has none. Negative ids are padding."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(key)
        out = np.full(key.shape, _NONE)
        flat, got = out.ravel(), self.keys[slot.ravel()]
        key, slot = key.ravel(), slot.ravel()
        hit = got == key
        flat[hit] = self.values[slot[hit]]
        todo = np.flatnonzero(~hit & (got != _EMPTY))
        for _ in range(self.probes):
            if not len(todo):
                break
            at = (slot[todo] + 1) & ((1 << self.bits) - 1)
            slot[todo] = at
            got = self.keys[at]
            hit = got == key[todo]
            flat[todo[hit]] = self.values[at[hit]]
            todo = todo[~hit & (got != _EMPTY)]
        out = flat.reshape(out.shape)
        out[(left < 0) | (right < 0)] = _NONE
        return out


class Bpe:
    """One vocabulary: ``rank_file`` is the content of a file of base64 tokens and ranks."""

    def __init__(self, rank_file: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_file.splitlines() if x)}
        self.ranks, self.pairs = ranks, PairTable(ranks)
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.known = np.zeros(size, bool)
        self.known[list(ranks.values())] = True
        self.token_len = np.array([len(x) for x in tokens], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)[:-1]])
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.cache = SpanCache(self._whole)

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        low = 0
        for width in _WIDTHS:
            rows = np.flatnonzero((size > low) & (size <= width))
            low = width
            for a in range(0, len(rows), CELLS // width):
                some = rows[a: a + CELLS // width]
                self._merge(some, size[some], pieces, width, out)
        for i in np.flatnonzero(size > low):
            out[i] = self._merge_long(pieces[i])
        return out

    def _merge(self, rows, size, pieces, width, out) -> None:
        raw = b"".join(pieces[i].ljust(width, b"\0") for i in rows)
        ids = self.byte_ids[np.frombuffer(raw, np.uint8)].reshape(len(rows), width)
        column = np.arange(width)
        ids[column >= size[:, None]] = -1
        rank = np.full((len(rows), width), _NONE)
        rank[:, :-1] = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        size = size.copy()
        while len(rows):
            at = rank.argmin(1)  # the leftmost of equal ranks
            line = np.arange(len(rows))
            best = rank[line, at]
            done = best == _NONE
            if done.any():
                for i, n, row in zip(rows[done], size[done], ids[done]):
                    out[i] = row[:n].tobytes()
                go = ~done
                rows, size, ids, rank, at, best = rows[go], size[go], ids[go], rank[go], at[go], best[go]
                line = np.arange(len(rows))
                if not len(rows):
                    return
                width = int(size.max())
                ids, rank = ids[:, :width], rank[:, :width]
            take = np.arange(ids.shape[1]) + (np.arange(ids.shape[1]) > at[:, None])
            ids = np.take_along_axis(np.pad(ids, ((0, 0), (0, 1)), constant_values=-1), take, 1)
            rank = np.take_along_axis(np.pad(rank, ((0, 0), (0, 1)), constant_values=_NONE), take, 1)
            ids[line, at] = best
            size -= 1
            after = np.where(at + 1 < ids.shape[1], ids[line, np.minimum(at + 1, ids.shape[1] - 1)], -1)
            rank[line, at] = self.pairs.ranks(best, after)
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.pairs.ranks(ids[left, at[left] - 1], best[left])

    def _merge_long(self, piece: bytes) -> bytes:
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that starts here
        prev = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i: i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(piece[i: end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if prev[i] >= 0 and (r := ranks.get(piece[prev[i]: stop])) is not None:
                heapq.heappush(heap, (r, prev[i], stop))
        return np.array([ranks[piece[i: end[i]]] for i in range(n) if alive[i]], np.int32).tobytes()

    def _whole(self, texts: list[str]) -> Coded:
        """Ids of each text, cut by the pattern."""
        find = self.pattern.findall
        split = [[t] if t[0] == " " and t[1:].isalpha() else find(t) for t in texts]
        distinct = list(set().union(*split))
        ids = dict(zip(distinct, self.pieces([p.encode() for p in distinct])))
        joined = [ids[x[0]] if len(x) == 1 else b"".join(map(ids.__getitem__, x)) for x in split]
        count = np.fromiter(map(len, joined), np.int64, len(joined)) // 4
        return np.frombuffer(b"".join(joined), np.uint32), np.cumsum(count) - count, count

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts one after the other, and the offsets of the texts."""
        return self.cache.texts(texts)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and where each id's bytes end."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        n = self.token_len[ids]
        end = np.cumsum(n)
        at = np.repeat(self.token_at[ids] - (end - n), n) + np.arange(int(end[-1]) if len(end) else 0)
        return self.token_bytes[at], end


def bpe_of(rank_file: bytes, pattern: str) -> Bpe:
    """The vocabulary's tables, built once per process."""
    made, key = process_cache(), ("bpe", zlib.crc32(rank_file), pattern)
    if key not in made:
        made[key] = Bpe(rank_file, pattern)
    return made[key]


def _vocabulary(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


def _encoded(bpe: Bpe, texts: pa.Array) -> pa.ListArray:
    values, offsets, total = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0
    for a, b in W.slices(texts, PART):
        ids, at = bpe.encode(texts[a:b])
        values.append(ids)
        offsets.append(at[1:] + total)
        total += len(ids)
    flat = np.concatenate(values).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(offsets).astype(np.int32)), pa.array(flat))


def _decoded(bpe: Bpe, lists: pa.ListArray) -> pa.Array:
    """The bytes of each list of ids."""
    lists = lists.fill_null([]) if lists.null_count else lists
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    return pa.array([bpe.decode(flat[a:b])[0].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the list of token ids of ``text``. The rank file is read by the driver."""
    bound_batches(df.sparkSession)
    held = _vocabulary(df, path)

    @F.arrow_udf(ArrayType(IntegerType()))
    def encoded(texts: pa.Array) -> pa.Array:
        return _encoded(bpe_of(held.value, pattern), texts)

    return df.withColumn(ids, encoded(F.col(f"`{text}`").cast("string")))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``df`` with the bytes that the list ``ids`` stands for."""
    bound_batches(df.sparkSession)
    held = _vocabulary(df, path)

    @F.arrow_udf(BinaryType())
    def decoded(lists: pa.Array) -> pa.Array:
        return _decoded(bpe_of(held.value, pattern), lists)

    # coalesce stands between the two functions: chained directly, each use of ids would encode again
    return df.withColumn(out, decoded(F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>"))))


def encode_and_decode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids",
                      out: str = "bytes") -> DataFrame:
    """``decode(encode(df))`` in one Python worker a task instead of two."""
    bound_batches(df.sparkSession)
    held = _vocabulary(df, path)

    @F.arrow_udf("ids array<int>, bytes binary")
    def both(texts: pa.Array) -> pa.Array:
        bpe = bpe_of(held.value, pattern)
        lists = _encoded(bpe, texts)
        return pa.StructArray.from_arrays([lists, _decoded(bpe, lists)], names=["ids", "bytes"])

    name = free_name(df, "_both")
    got = df.withColumn(name, both.asNondeterministic()(F.col(f"`{text}`").cast("string")))
    return got.withColumns({ids: F.col(name)["ids"], out: F.col(name)["bytes"]}).drop(name)
