"""Token ids in binary shards with Elias-Fano document boundaries.

A shard image is one byte string: a header, the boundaries of its documents, their ids in
the corpus (both Elias-Fano coded) and all token ids one after the other, 16 or 32 bits
each. n boundaries up to u take about ``2 + log2(u / n)`` bits each; a sample of every
256th set bit and a popcount over the words behind it give any boundary without a table
of offsets.

Images are written by the tasks that hold a range of document ids, one or more per task,
as rows of a Parquet table, because only Spark reaches the file system of a cluster. Rows
are in ascending document id, nulls first; equal ids are ordered by a hash of the text.

Defined results: null and empty texts hold the end id alone; repeated rows are written
each; an empty table writes no shard. Extra columns are ignored. Keys are whole numbers, or texts of
such; other texts are an error.
"""

from __future__ import annotations

import os
import struct
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meadowlark.llm import words as W
from meadowlark.llm.batches import bound_batches, process_cache
from meadowlark.llm.spans import PART, Coded, SpanCache, coded

SHARD_IDS = 1 << 22  # a shard is closed with the document that reaches this
SAMPLE = 256
SPANS = 600_000  # that a process remembers
_HEAD = "<4sHHqqqq"
_PART = "<qqqqq"


class EliasFano:
    """A non-decreasing sequence of non-negative integers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros((int(ones[-1]) // 64 + 1) * 64 if n else 0, np.uint8)
        flags[ones] = 1
        low = np.zeros((n * bits + 63) // 64 * 64, np.uint8)
        for b in range(bits):
            low[np.arange(n) * bits + b] = (values >> np.uint64(b)) & np.uint64(1)
        return cls(n, bits, np.packbits(low, bitorder="little").view("<u8"),
                   np.packbits(flags, bitorder="little").view("<u8"), ones[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left, word = i % SAMPLE, at // 64
        bits = int(self.high[word]) >> (at % 64) << (at % 64)
        while (held := bits.bit_count()) <= left:
            left -= held
            word += 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        position = word * 64 + (bits & -bits).bit_length() - 1
        low, b = 0, self.low_bits
        if b:
            first, shift = divmod(i * b, 64)
            low = int(self.low[first]) >> shift
            if shift + b > 64:
                low |= int(self.low[first + 1]) << (64 - shift)
            low &= (1 << b) - 1
        return (position - i) << b | low

    def values(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        low = np.unpackbits(self.low.view(np.uint8), bitorder="little")
        for b in range(self.low_bits):
            out |= low[np.arange(self.n) * self.low_bits + b].astype(np.uint64) << np.uint64(b)
        return out

    def dump(self) -> bytes:
        head = struct.pack(_PART, self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return b"".join([head, self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()])

    @classmethod
    def load(cls, image: memoryview, at: int) -> tuple[EliasFano, int]:
        n, bits, n_low, n_high, n_samples = struct.unpack_from(_PART, image, at)
        at += struct.calcsize(_PART)
        low = np.frombuffer(image, "<u8", n_low, at)
        high = np.frombuffer(image, "<u8", n_high, at + 8 * n_low)
        at += 8 * (n_low + n_high)
        return cls(n, bits, low, high, np.frombuffer(image, "<u4", n_samples, at)), at + 4 * n_samples


def pack_shard(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """The image of some documents; null ids come first, the others ascend."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    width = 2 if not len(flat) or flat.max() < 1 << 16 else 4
    nulls = sum(x is None for x in doc_ids)
    known = [x for x in doc_ids if x is not None]
    base = known[0] if known else 0
    ends = EliasFano.of(np.cumsum([len(x) for x in ids]))
    keys = EliasFano.of(np.array([x - base for x in known], np.uint64))
    head = struct.pack(_HEAD, b"EFID", 1, width, len(ids), len(flat), nulls, base)
    return b"".join([head, ends.dump(), keys.dump(), flat.astype(f"<u{width}").tobytes()])


class Shard:
    """An opened image: ``doc(i)`` and ``doc_id(i)`` select one document, ``doc_ids`` expands all ids."""

    def __init__(self, image: bytes):
        magic, version, width, self.n, self.n_ids, self.nulls, self.base = struct.unpack_from(_HEAD, image, 0)
        if (magic, version) != (b"EFID", 1):
            raise ValueError("not a token shard")
        self.ends, at = EliasFano.load(memoryview(image), struct.calcsize(_HEAD))
        self.keys, at = EliasFano.load(memoryview(image), at)
        self.ids = np.frombuffer(image, f"<u{width}", self.n_ids, at)

    def doc(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0: self.ends.select(i)]

    def doc_id(self, i: int) -> int | None:
        return self.keys.select(i - self.nulls) + self.base if i >= self.nulls else None

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + [int(x) + self.base for x in self.keys.values()]


def _encoder(model: bytes) -> SpanCache:
    """The tokenizer of this process. Each distinct span goes through the library once."""
    made, key = process_cache(), ("tokenizer", zlib.crc32(model))
    if key not in made:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(model.decode())
        special = tuple(x.content for x in tokenizer.get_added_tokens_decoder().values())
        lengths = np.zeros(tokenizer.get_vocab_size(), np.int64)
        for token, i in tokenizer.get_vocab().items():
            lengths[i] = len(token)  # byte-level tokens have a character for each byte

        def whole(texts: list[str]) -> list[np.ndarray]:
            return [np.array(x.ids, np.uint32) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        made[key] = SpanCache(lambda texts: _apart(texts, whole, lengths, special), SPANS, special)
    return made[key]


def _apart(texts: list[str], whole, lengths: np.ndarray, special: tuple[str, ...] = ()) -> Coded:
    """Each of many spans through few calls of the library. Those that begin with their only space
    and end in a letter or mark are joined: a space cuts them, and ids stand for as many bytes as
    their tokens have, so the ids fall back into spans."""
    flat, used = [], 0
    start, count = np.zeros(len(texts), np.int64), np.full(len(texts), -1)
    joined = [i for i, t in enumerate(texts) if t[0] == " " and not t[-1].isspace() and " " not in t[1:]
              and not any(x in t for x in special)]
    for a in range(0, len(joined), 20_000):
        some = joined[a: a + 20_000]
        data = "".join(texts[i] for i in some).encode()
        ids = whole([data.decode()])[0]
        ends = np.cumsum(lengths[ids])
        stops = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 32)[1:], len(data))
        cuts = np.searchsorted(ends, stops)
        if len(stops) != len(some) or ends[-1] != len(data) or (ends[cuts] != stops).any():
            continue  # a tokenizer that does not keep all bytes
        start[some] = used + np.append(0, cuts[:-1] + 1)
        count[some] = np.diff(cuts, prepend=-1)
        flat.append(ids)
        used += len(ids)
    rest = np.flatnonzero(count < 0)
    ids, at, count[rest] = coded(whole([texts[i] for i in rest]) if len(rest) else [])
    start[rest] = used + at
    return np.concatenate([*flat, ids]), start, count


def write_token_files(docs: DataFrame, path: str, model: str, end_id: int | None = None, key: str = "doc_id",
                      text: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encode ``text`` with the tokenizer file ``model`` and write shards to ``path``.

    Texts are shuffled once, by ranges of the key. A task holds one open shard.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    held = spark.sparkContext.broadcast(Path(model).read_bytes())
    picked = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = picked.repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches):
        encoder, part, shard, start = _encoder(held.value), TaskContext.get().partitionId(), 0, 0
        doc_ids, ids, total = [], [], 0
        tail = np.array([] if end_id is None else [end_id], np.uint32)

        def row():
            image = pack_shard(doc_ids, ids)
            return pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "start": [start], "n_docs": [len(ids)],
                                               "n_ids": [total], "image": [image]}, schema=_SHARDS)

        for batch in batches:
            texts = batch.column(1)
            for a, b in W.slices(texts, PART):
                flat, at = encoder.texts(texts[a:b])
                for i, doc_id in enumerate(batch.column(0)[a:b].to_pylist()):
                    doc_ids.append(doc_id)
                    ids.append(np.append(flat[at[i]: at[i + 1]], tail))
                    total += len(ids[-1])
                    if total >= shard_ids:
                        yield row()
                        shard, start, doc_ids, ids, total = shard + 1, start + total, [], [], 0
        if ids:
            yield row()

    ranged.mapInArrow(write, _COLUMNS).write.option("compression", "zstd").parquet(path)


_COLUMNS = "part int, shard int, start long, n_docs long, n_ids long, image binary"
_SHARDS = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("start", pa.int64()), ("n_docs", pa.int64()),
                     ("n_ids", pa.int64()), ("image", pa.binary())])


def _documents(batches):
    """The documents of (start, image) rows, each found by select."""
    for batch in batches:
        for start, image in zip(batch.column(0).to_pylist(), batch.column(1)):
            shard = Shard(image.as_buffer())
            for a in range(0, shard.n, 256):
                some = range(a, min(a + 256, shard.n))
                docs = [shard.doc(i) for i in some]
                sizes = np.array([len(x) for x in docs], np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard.doc_id(i) for i in some], pa.int64()), pa.array(start + np.cumsum(sizes) - sizes), pa.array(sizes),
                    pa.array([x.astype("<u4").tobytes() for x in docs], pa.binary()),
                ], ["doc_id", "start", "n_tokens", "ids"])
                start += int(sizes.sum())


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the shards in ``path``: doc_id, start (ids before it in the whole
    array), n_tokens and its ids as little-endian 32-bit integers.

    A shard knows its start within the range its task wrote; the ranges' totals, one row
    per writing task, give the rest.
    """
    shards = spark.read.schema(_COLUMNS).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = shards.join(F.broadcast(ranges), "part").select((F.col("before") + F.col("start")).alias("start"), "image")

    return placed.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids binary")
