"""Spelling variant grouping: words one edit apart, found by asymmetric q-chunks.

The shorter word of a pair (of two of equal length either) gives two disjoint chunks, its
halves; the other gives its positional grams of the same size. One edit leaves one chunk whole,
and in the other word it stands at the same place or one further on, so the two words meet in a
join on chunk and place. What the chunk leaves over is one edit apart in turn and is chunked
the same way once more, so that a frequent half does not gather all the words that share it: a
key is a word without one of its quarters, and the two quarters left out are verified to be one
edit apart. Grams at places that the word lengths rule out are not sent.

Tokens are the maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of whole texts, of which only A-Z is
lower-cased. A token whose crc32 of ``<doc_id>:<token>`` is divisible by ``noise`` loses the code
point at crc32 % length. Words are the distinct results of at least ``least_length`` code points
and ``least_count`` occurrences. Tokens are counted in the tasks, on bytes.

A word's form is its most frequent near word (ties: least in code-point order) if that occurs at
least ``ratio`` times as often as the word itself; its root is where the forms lead. Counts grow
along forms, so there are no circles.

Defined results: a null text has no tokens; a null id is read as ''. Rows of equal id count one
by one. Words without near words have n_near 0, no form, and themselves as root. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meadowlark.llm import words as W
from meadowlark.llm.batches import bound_batches, written

LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
NOISE = 199
HELD = 300_000  # distinct tokens that a task holds before it sends them
STEPPED = 64  # longer tokens are hashed one by one
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[range(0x61, 0x7B)] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def token_spans(data: np.ndarray, at: np.ndarray):
    """Begin and end of the tokens in lower-cased bytes, and the row offsets. U+00C0 to U+00FF
    are the byte 0xC3 with any byte after it."""
    letter = _LETTER[data]
    lead = np.flatnonzero(data == 0xC3)
    letter[lead] = True
    letter[lead + 1] = True
    return W.word_spans(data, at, letter)


def crc_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of every span, continued from the crc32 ``state`` of what goes before it."""
    crc = ~state
    size = end - begin
    todo = np.flatnonzero(size <= STEPPED)
    for k in range(STEPPED):
        todo = todo[size[todo] > k]
        if not len(todo):
            break
        crc[todo] = _CRC[(crc[todo] ^ data[begin[todo] + k]) & np.uint32(0xFF)] ^ (crc[todo] >> np.uint32(8))
    crc = ~crc
    for i in np.flatnonzero(size > STEPPED).tolist():
        crc[i] = zlib.crc32(data[begin[i]: end[i]].tobytes(), int(state[i]))
    return crc


def strings(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans as an Arrow array of strings."""
    stop = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
    raw = data[np.repeat(begin - stop[:-1], end - begin) + np.arange(stop[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(stop), pa.py_buffer(raw)])


def slice_words(ids: pa.Array, texts: pa.Array, least_length: int, noise: int) -> pa.Table:
    """(word, n) of some rows."""
    data, at = W.utf8(texts)
    data = _LOWER[data]
    begin, end, offsets = token_spans(data, at)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    length = points[end] - points[begin]
    row = np.repeat(np.arange(len(at) - 1), np.diff(offsets))
    long = length >= least_length  # a shorter token only gets shorter
    begin, end, length, row = begin[long], end[long], length[long], row[long]
    state = np.array([zlib.crc32(f"{i or ''}:".encode()) for i in ids.to_pylist()], np.uint32)
    crc = crc_of(data, begin, end, state[row])
    hit = crc % np.uint32(noise) == 0
    changed = []
    for i in np.flatnonzero(hit & (length > least_length)).tolist():
        token = data[begin[i]: end[i]].tobytes().decode()
        gone = int(crc[i]) % len(token)
        changed.append(token[:gone] + token[gone + 1:])
    found = pa.concat_arrays([strings(data, begin[~hit], end[~hit]), pa.array(changed, pa.large_string())])
    counted = pc.value_counts(found)
    return pa.table({"word": counted.field(0), "n": counted.field(1)})


def merge(tables: list[pa.Table]) -> pa.Table:
    summed = pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n", "sum")])
    return pa.table({"word": summed["word"], "n": summed["n_sum"]})


def word_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT, noise: int = NOISE) -> DataFrame:
    """(word, n) of the words of ``docs``. A task sends a frequent word only a few times."""
    def count(batches):
        held, rows = [], 0
        for batch in batches:
            for a, b in W.slices(batch.column(1)):
                held.append(slice_words(batch.column(0)[a:b], batch.column(1)[a:b], least_length, noise))
                rows += len(held[-1])
                if rows > HELD:
                    held = [merge(held)]
                    rows = len(held[0])
                    if rows > HELD // 2:
                        yield from sent(held[0])
                        held, rows = [], 0
        if held:
            yield from sent(merge(held))

    def sent(table):
        return table.cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches(8192)

    bound_batches(docs.sparkSession)
    picked = docs.select(F.col(key).cast("string"), F.col(text).cast("string"))
    counted = picked.mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _keys(word: Column, m: Column, longer: int) -> Column:
    """(kept, hole) of a word for partners of ``m`` code points, ``longer`` (0 or 1) fewer than its
    own: for each half that is kept whole, and each half of the rest, what is kept and what is not."""
    half = F.floor(m / 2).cast("int")
    second, of_first = half + F.floor((m - half) / 2).cast("int"), F.floor(half / 2).cast("int")
    size = m + longer
    holes = [  # begin and end of what is left out; the grams after it stand ``longer`` further on
        (second, size), (half, second + longer),  # first half kept: its rest without the second or the first part
        (of_first, half + longer), (F.lit(0), of_first + longer),  # second half kept
    ]
    return F.array(*[
        F.struct(F.concat(F.substring(word, F.lit(1), a), F.lit("_"), F.substring(word, b + 1, size - b)).alias("kept"),
                 F.substring(word, a + 1, b - a).alias("hole"))
        for a, b in holes])


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): every two words of (word, n) that are one edit apart, once."""
    m = F.char_length("word")
    grams = words.select("word", "n", F.explode(_keys(F.col("word"), m, 0)).alias("k"))
    wider = words.select("word", "n", F.explode(_keys(F.col("word"), m - 1, 1)).alias("k"))
    chunks = grams.select(F.col("k.kept").alias("kept"), F.col("k.hole").alias("hole_a"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    others = grams.unionByName(wider).select(F.col("k.kept").alias("_kept"), F.col("k.hole").alias("hole_b"),
                                             F.col("word").alias("b"), F.col("n").alias("n_b"))
    longer = F.char_length("hole_b") - F.char_length("hole_a")  # as much as b is longer than a
    met = chunks.join(others, (F.col("kept") == F.col("_kept")) & ((longer == 1) | ((longer == 0) & (F.col("a") < F.col("b"))))
                      & (F.levenshtein("hole_a", "hole_b", 1) == 1))
    # an inserted letter equal to its neighbour may stand in either of two quarters
    return met.select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): each round doubles how far a word has come along its forms."""
    at = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = at.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        step = at.join(further, F.col("root") == F.col("_word"), "left")
        step = written(step.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_moved")),
                       "spelling-roots")
        at = step.drop("_moved")
        if not step.where("_moved").limit(1).count():
            return at


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a table (word, n) of distinct words."""
    words = written(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    pairs = written(near_pairs(words), "spelling-pairs")
    both = pairs.select(F.col("a").alias("_word"), F.col("b").alias("near"), F.col("n_b").alias("n_near")).union(
        pairs.select(F.col("b"), F.col("a"), F.col("n_a")))
    # of equal counts the least word: the smallest of (-n, word)
    near = both.groupBy("_word").agg(F.count(F.lit(1)).alias("n_near"),
                                     F.min(F.struct((-F.col("n_near")).alias("minus"), "near")).alias("best"))
    joined = words.join(near, F.col("word") == F.col("_word"), "left")
    formed = -F.col("best.minus") >= ratio * F.col("n")
    held = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                 F.when(formed, F.col("best.near")).alias("form"),
                                 F.when(formed, -F.col("best.minus")).alias("form_n")), "spelling-forms")
    ends = roots(held.where("form IS NOT NULL")).toDF("_word", "_root")
    out = held.join(ends, F.col("word") == F.col("_word"), "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("_root", "word").alias("root"))


SQL = r"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_concat([i::BIGINT], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM range(256) x(i))),
d AS (SELECT row_number() OVER () AS r, coalesce(CAST(doc_id AS VARCHAR), '') AS id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+') AS w FROM documents),
t AS (SELECT id, run, count(*) AS n FROM (SELECT id, unnest(w) AS run FROM d) WHERE length(run) >= 6 GROUP BY id, run),
h AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], list_transform(range(octet_length(s)), lambda i: ('0x' || substr(hex(s), 2 * i + 1, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS h
      FROM (SELECT run, n, encode(id || ':' || run) AS s FROM t), tab),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 199 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM h)
      WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
del AS MATERIALIZED (SELECT word, n, i, word[: i - 1] || word[i + 1 :] AS rest
      FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT DISTINCT a, b, n FROM (
      SELECT x.word AS a, y.word AS b, y.n AS n FROM del x JOIN del y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
      UNION ALL SELECT x.word, y.word, y.n FROM w x JOIN del y ON x.word = y.rest
      UNION ALL SELECT y.word, x.word, x.n FROM w x JOIN del y ON x.word = y.rest)),
best AS (SELECT a, count(*) AS n_near, max(n) AS n FROM near GROUP BY a),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(best.n_near, 0)::BIGINT AS n_near,
      CASE WHEN best.n >= 5 * w.n THEN (SELECT min(b) FROM near WHERE near.a = w.word AND near.n = best.n) END AS form,
      CASE WHEN best.n >= 5 * w.n THEN best.n END AS form_n FROM w LEFT JOIN best ON best.a = w.word),
walk AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL
      SELECT walk.word, f.form, step + 1 FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n
FROM f JOIN (SELECT word, arg_max(root, step) AS root FROM walk GROUP BY word) e USING (word)
"""
