"""Benchmark decontamination: a prefix-filtered set join of documents with benchmark items.

Every item is cut into windows of ``window`` consecutive words; a shorter item is one window. A
window is a set of shingles (up to five words), and a document holds the window only if it holds
all of them, so the prefix that must be joined is one shingle: the rarest by its count over all
documents. A window with a shingle that no document holds is dropped. Documents send the words
around each place where a prefix shingle may stand; the join on the shingle then applies the
positional bound (the window's words before the shingle must exist), the length bound (those
after it too), and compares the words themselves. Hashes only choose what is compared.

What tasks get besides texts are two filters of at most 16 MB (``bloom``), one of all shingles
of the benchmark for counting and one of the prefix shingles; the benchmark is joined as a table.

Words are runs of digits, a-z and all characters beyond ASCII, after lower-casing A-Z. Defined
results: null or empty texts have no words, and an item without words has no window. Rows of
equal or null id are judged one by one. Repeated items count once; an item whose id is null
marks words but is not listed. Without items or documents nothing is hit. Other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meadowlark.llm import bloom
from meadowlark.llm import words as W
from meadowlark.llm.batches import append_columns, bound_batches, written

WINDOW = 10
SHINGLE = 5
HELD = 500_000  # shingle counts a task holds before it sends them
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def tokens(texts: pa.Array):
    """Lower-cased bytes of the rows, begin and end of their words, word offsets and word hashes."""
    data, at = W.utf8(texts)
    data = _LOWER[data]
    begin, end, offsets = W.word_spans(data, at, _WORD[data])
    return data, begin, end, offsets, W.span_hashes(data, begin, end)


def phrases(data: np.ndarray, begin: np.ndarray, end: np.ndarray, first, last) -> list[str]:
    """The words first to last - 1, joined by one space, for every pair of word numbers."""
    out = []
    for a, b in zip(first.tolist(), last.tolist()):
        base = int(begin[a])
        raw = data[base: int(end[b - 1])].tobytes()
        out.append(b" ".join([raw[x:y] for x, y in zip((begin[a:b] - base).tolist(), (end[a:b] - base).tolist())]).decode())
    return out


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """(item, window, size, hashes): every window of every item, and the hashes of its shingles in order."""
    def cut(batches):
        for batch in batches:
            for a, b in W.slices(batch.column(1)):
                ids, texts = batch.column(0)[a:b], batch.column(1)[a:b]
                data, begin, end, offsets, h = tokens(texts)
                n_words = np.diff(offsets)
                row = np.repeat(np.arange(b - a), np.where(n_words >= window, n_words - window + 1, (n_words > 0).astype(int)))
                if not len(row):
                    continue
                size = np.minimum(n_words[row], window)
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                first = offsets[row] + nth
                hashes = [None] * len(row)
                for n in np.unique(np.minimum(size, shingle)).tolist():
                    all_n, place = W.windows(h, offsets, n)
                    start = np.searchsorted(place, first)
                    for i in np.flatnonzero(np.minimum(size, shingle) == n).tolist():
                        hashes[i] = all_n[start[i]: start[i] + int(size[i]) - n + 1].view(np.int64)
                text = phrases(data, begin, end, first, first + size)
                for c in range(0, len(row), 4096):
                    at = slice(c, c + 4096)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(row[at])), pa.array(text[at], pa.string()), pa.array(size[at], pa.int32()),
                         pa.array(hashes[at], pa.list_(pa.int64()))], ["item", "window", "size", "hashes"])

    return items.mapInArrow(cut, "item string, window string, size int, hashes array<long>")


def shingle_counts(docs: DataFrame, cells: np.ndarray, sizes: list[int]) -> DataFrame:
    """(hash, n): how often the shingles that the filter lets pass occur in the texts of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(cells)

    def count(batches):
        found, rows = [], 0

        def summed():
            h, where = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
            n = np.zeros(len(h), np.int64)
            np.add.at(n, where, np.concatenate([n for _, n in found]))
            return h, n

        def sent(h, n):
            for a in range(0, len(h), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(h[a: a + 8192].view(np.int64)), pa.array(n[a: a + 8192])], ["hash", "n"])

        for batch in batches:
            for a, b in W.slices(batch.column(0)):
                *_, offsets, h = tokens(batch.column(0)[a:b])
                for n in sizes:
                    some, _ = W.windows(h, offsets, n)
                    found.append(np.unique(some[bloom.maybe(held.value, some)], return_counts=True))
                    rows += len(found[-1][0])
            if rows > HELD:
                found = [summed()]
                rows = len(found[0][0])
                if rows > HELD // 2:
                    yield from sent(*found[0])
                    found, rows = [], 0
        if found:
            yield from sent(*summed())

    return docs.mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def candidates(texts: pa.Array, cells: np.ndarray, sizes: list[int], window: int):
    """Words of each row, and where a prefix shingle may stand with the words around it."""
    n_words, places = [], []
    for a, b in W.slices(texts):
        data, begin, end, offsets, h = tokens(texts[a:b])
        mine = [[] for _ in range(b - a)]
        for n in sizes:
            some, at = W.windows(h, offsets, n)
            hit = bloom.maybe(cells, some)
            if not len(hit):
                continue
            at, found = at[hit], some[hit].view(np.int64)
            row = np.searchsorted(offsets, at, "right") - 1
            first = np.maximum(offsets[row], at - (window - n))
            last = np.minimum(offsets[row + 1], at + window)
            words = phrases(data, begin, end, first, last)
            for r, x, start, before, text in zip(row.tolist(), found.tolist(), (first - offsets[row]).tolist(),
                                                 (at - first).tolist(), words):
                mine[r].append({"hash": x, "start": start, "before": before, "words": text})
        n_words.append(np.diff(offsets))
        places += mine
    return [np.concatenate(n_words) if n_words else np.zeros(0, np.int64), places]


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(hash, offset, size, window): the rarest shingle of every window of which all shingles occur."""
    ordered = windows.select("window", "size", F.posexplode("hashes").alias("offset", "hash"))
    rare = (ordered.join(counts, "hash", "left").groupBy("window", "size")
            .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "offset")).alias("p")))
    return rare.where("p.n > 0").select("p.hash", "p.offset", "size", "window")


def matches(found: DataFrame, prefix: DataFrame) -> DataFrame:
    """(row, start, size, window) of every window that stands in a document, words compared."""
    placed = found.select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    begin = F.col("before") - F.col("offset")
    cut = F.array_join(F.slice(F.split("words", " "), F.greatest(begin + 1, F.lit(1)), F.col("size")), " ")
    joined = placed.join(prefix.withColumnRenamed("hash", "_hash"),
                         (F.col("hash") == F.col("_hash")) & (begin >= 0) & (cut == F.col("window")))
    return joined.select("row", (F.col("start") + begin).cast("long").alias("start"), "size", "window")


def spans_of(hits: DataFrame) -> DataFrame:
    """(row, n_hit, spans): the words that lie in any match, and the runs that they form."""
    order = Window.partitionBy("row").orderBy("start", "size")
    before = F.max(F.col("start") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = hits.withColumn("_before", before).withColumn(
        "_new", (F.col("_before").isNull() | (F.col("start") > F.col("_before"))).cast("int"))
    runs = (opened.withColumn("_run", F.sum("_new").over(order)).groupBy("row", "_run")
            .agg(F.min("start").alias("begin"), F.max(F.col("start") + F.col("size")).alias("stop")))
    return runs.groupBy("row").agg(F.sum(F.col("stop") - F.col("begin")).cast("long").alias("n_hit"),
                                   F.array_sort(F.collect_list(F.struct("begin", "stop"))).alias("spans"))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id",
                  item_text: str = "text", item_key: str = "item_id", window: int = WINDOW,
                  shingle: int = SHINGLE) -> DataFrame:
    """Per row of ``docs``: key, n_words, n_hit, spans of hit words (begin, stop), the sorted
    ids of the items with a window in it (as strings), n_items and contaminated."""
    spark = docs.sparkSession
    bound_batches(spark)
    cut = written(item_windows(items.select(F.col(item_key).cast("string"), F.col(item_text).cast("string")),
                               window, shingle), "benchmark-windows")
    windows = cut.dropDuplicates(["window"]).select("window", "size", "hashes")
    sizes = sorted({min(r[0], shingle) for r in cut.select("size").distinct().collect()})  # window + 1 values at most
    hashes = windows.select(F.explode("hashes").alias("hash")).distinct()
    texts = docs.select(F.col(text).cast("string").alias("text"))
    counts = shingle_counts(texts, bloom.build(hashes, hashes.count()), sizes)
    prefix = written(prefixes(windows, counts), "benchmark-prefixes")
    least = prefix.select("hash").distinct()
    cells = spark.sparkContext.broadcast(bloom.build(least, least.count()))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    results = {"n_words": "long", "candidates": "array<struct<hash: long, start: long, before: int, words: string>>"}
    found = append_columns(rows, "_text", lambda x: candidates(x, cells.value, sizes, window), results)
    found = written(found.drop("_text").withColumn("n_places", F.size("candidates")), "benchmark-candidates")
    hits = written(matches(found.where("n_places > 0"), prefix), "benchmark-matches")
    listed = cut.where("item IS NOT NULL").select("window", "item").distinct()
    named = (hits.select("row", "window").distinct().join(listed, "window").select("row", "item").distinct()
             .groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items")))
    marked = (found.where("n_places > 0").select("row", "_key", "n_words")
              .join(spans_of(hits), "row", "left").join(named, "row", "left"))
    clean = found.where("n_places = 0").select("_key", "n_words")
    both = marked.drop("row").unionByName(clean, allowMissingColumns=True)
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return both.select(F.col("_key").alias(key), "n_words", n_hit.alias("n_hit"),
                       F.coalesce("spans", F.array().cast("array<struct<begin: long, stop: long>>")).alias("spans"),
                       items_of.alias("items"), F.size(items_of).cast("long").alias("n_items"), (n_hit > 0).alias("contaminated"))


SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS MATERIALIZED (SELECT item_id, regexp_extract_all(
       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT item_id, w, least(10, len(w)) AS l, unnest(range(1, greatest(len(w) - 8, 2))) AS pos FROM i WHERE len(w) > 0),
win AS MATERIALIZED (SELECT DISTINCT item_id, l, array_to_string(w[pos : pos + l - 1], ' ') AS win FROM p),
g AS (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS pos FROM d, (SELECT DISTINCT l FROM win)),
hit AS MATERIALIZED (SELECT r, pos, l, win FROM (SELECT r, pos, l, array_to_string(w[pos : pos + l - 1], ' ') AS win FROM g)
       WHERE (win, l) IN (SELECT win, l FROM win)),
n AS (SELECT r, count(DISTINCT pos + k) AS n FROM (SELECT r, pos, unnest(range(l)) AS k FROM hit) GROUP BY r),
s AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit JOIN win USING (win, l) WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(s.n, 0)::BIGINT AS n_items,
  sha256(coalesce(s.ids, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN s USING (r)
"""
