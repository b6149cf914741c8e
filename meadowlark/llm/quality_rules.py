"""Quality rules: plain base rules, then a log-likelihood ratio of hashed n-grams.

Words and word pairs of every text fall into ``buckets`` hash buckets. Two multinomials
over the buckets are counted, one over all documents (raw) and one over a trusted
target, both smoothed. A document's score is the mean over its n-grams of
``log p_target - log p_raw``; it is kept when the score reaches a threshold. Nothing is
drawn at random, so equal texts get equal verdicts.

Defined results: a null or empty text has no words, score 0 and fails the base rules
(under ten words). Repeated rows and ids are judged one by one. Extra columns pass
through; a column named as one of the results is replaced. With an empty target both
multinomials are equal and all scores are 0.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meadowlark.llm import words as W
from meadowlark.llm.batches import append_columns, bound_batches

BUCKETS = 1 << 18
SMOOTHING = 10.0  # n-grams of the target added to every bucket of both
THRESHOLD = -0.12  # nats per n-gram
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
BROADCAST_IDS = 1_000_000  # trusted ids that are sent to every executor; more are joined by a shuffle
RESULTS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long",
           "n_repeat_words": "long", "llr": "double"}


def ngram_buckets(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of the rows, and the row of each."""
    h, offsets = W.word_hashes(*W.utf8(texts))
    return _buckets(h, offsets, buckets)


def _buckets(h, offsets, buckets):
    pairs, at = W.windows(h, offsets, 2)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    shift = np.uint64(64 - int(math.log2(buckets)))
    return np.concatenate([h >> shift, pairs >> shift]).astype(np.int64), np.concatenate([row, row[at]])


def bucket_counts(docs: DataFrame, text: str = "text", trusted: str | None = None,
                  buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target) of all documents. Each partition sums its own counts, so it
    sends at most ``buckets`` rows; ``trusted`` names a boolean column."""
    picked = docs.select(F.col(text).cast("string").alias("text"),
                         (F.coalesce(F.col(trusted), F.lit(False)) if trusted else F.lit(False)).alias("trusted"))

    def count(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            flags = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in W.slices(batch.column(0)):
                bucket, row = ngram_buckets(batch.column(0)[a:b], buckets)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[flags[a:b][row]], minlength=buckets)
        held = np.flatnonzero(raw)
        for a in range(0, len(held), 8192):
            at = held[a: a + 8192]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])],
                                             ["bucket", "raw", "target"])

    counted = picked.mapInArrow(count, "bucket long, raw long, target long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """log p_target - log p_raw of every bucket: ``buckets`` numbers, whatever the corpus."""
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counts.toLocalIterator():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(buckets)
    share = target.sum() / raw.sum()  # both multinomials get the same prior, in the target's size
    return np.log((target + smoothing) / (raw * share + smoothing))


def text_facts(texts: pa.Array, ratios: np.ndarray) -> list[np.ndarray]:
    """The columns of RESULTS for a batch of texts."""
    data, at = W.utf8(texts)
    begin, end, offsets = W.word_spans(data, at)
    h = W.span_hashes(data, begin, end)
    n_words = np.diff(offsets)
    word = ~W._SPACE[data]
    word_chars = W.per_row(word & ((data & 0xC0) != 0x80), at)
    n_symbols = W.per_row(_SYMBOL[data], at)

    # lines: a row's first byte and every byte after a newline begin one; lines without a word don't count
    newline = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([at, newline, newline + 1]))
    a, b = edges[:-1], edges[1:]
    full = (b - a > 1) | (data[a] != 10) if len(a) else np.zeros(0, bool)
    a, b = a[full], b[full]
    worded = np.searchsorted(begin, b) > np.searchsorted(end, a, "right")
    a, b = a[worded], b[worded]
    row = np.searchsorted(at, a, "right") - 1
    with np.errstate(over="ignore"):
        key = W.mix(W.span_hashes(data, a, b) + row.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    _, first = np.unique(key, return_index=True)
    n_dup_lines = np.bincount(row, minlength=len(at) - 1) - np.bincount(row[first], minlength=len(at) - 1)

    shingles, pos = W.windows(h, offsets, 5)
    word_row = np.repeat(np.arange(len(at) - 1), n_words)
    again = pos[W.repeated(shingles, word_row[pos])]
    depth = np.zeros(len(h) + 6, np.int32)
    np.add.at(depth, again, 1)
    np.add.at(depth, again + 5, -1)
    n_repeat = W.per_row(np.cumsum(depth)[: len(h)] > 0, offsets)

    bucket, at_row = _buckets(h, offsets, len(ratios))
    grams = np.bincount(at_row, minlength=len(at) - 1)
    llr = np.bincount(at_row, weights=ratios[bucket], minlength=len(at) - 1) / np.maximum(grams, 1)
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat, llr]


def judge(docs: DataFrame, ratios: np.ndarray, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``docs`` with RESULTS, base_failed and kept."""
    held = docs.sparkSession.sparkContext.broadcast(ratios)

    def facts(texts):
        parts = [text_facts(texts[a:b], held.value) for a, b in W.slices(texts)]
        return [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0)] * len(RESULTS)

    out = append_columns(docs, text, facts, RESULTS)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= F.lit(threshold)))


def quality_rules(docs: DataFrame, trusted_ids: DataFrame, text: str = "text", key: str = "doc_id",
                  buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` judged against the documents whose ``key`` is in the one column of ``trusted_ids``.

    The corpus is read twice: once to count, once to score. Only the counting pass
    meets the trusted ids; a repeated id counts once.
    """
    bound_batches(docs.sparkSession)
    ids = trusted_ids.toDF("_id").where("_id IS NOT NULL").distinct().withColumn("_trusted", F.lit(True))
    if ids.count() <= BROADCAST_IDS:  # some ten bytes each; texts then stay where they were read
        ids = F.broadcast(ids)
    marked = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(
        ids, F.col("_key") == F.col("_id"), "left")
    ratios = log_ratios(bucket_counts(marked, "_text", "_trusted", buckets), buckets)
    return judge(docs, ratios, text, threshold)
