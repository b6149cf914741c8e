"""Source divergence audit: which sources of a language use other words than the rest.

Partial counts come from Arrow compute functions inside ``mapInArrow``: texts are lower-cased
with ``ascii_lower``, cut with ``split_pattern_regex``, their terms dictionary-encoded and
counted by hash ``group_by``. Each task merges its partial counts before it sends them. The
kept terms, one row each with the counts of all sources, are then dealt into shards by the hash
of the term; a shard is one columnar matrix of sources by terms, from which the divergence of
every two sources and of every source from its language is summed. The shards' sums are added.

Terms are runs of ASCII letters and of all characters beyond ASCII; only A-Z is lower-cased. A
language keeps the terms of at least ``least_docs`` of its documents, V in number. With N
occurrences of kept terms a group gives a term with ``count`` of them
``p = 1 + floor(10**9 * (count + 2) / (N + 2 * V))``, and two such numbers diverge by
``floor((p - q)**2 / (p + q))``. All arithmetic is exact up to 9 * 10**15 occurrences.

Defined results: null text, language and source read as ''. A group without terms gives every
kept term the same p. In a language without kept terms all pairs have value 0 and no terms are
reported; a language of one source has no pairs. Repeated rows count again. An empty table gives
no rows. Ties are ordered by the UTF-8 bytes of the item. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meadowlark.llm import words as W
from meadowlark.llm.batches import bound_batches, written
from meadowlark.scale import top_per

NOT_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS = 10
TOP = 10
SLICE = 1 << 22  # bytes of text cut into terms at a time
HELD = 400_000  # partial counts that a task holds before it sends them
SHARD = 20_000  # kept terms in a shard, on average
CELLS = 1 << 19  # counts of a matrix worked on at once
UNIT = 1000  # 10**9 is divided in three steps of this, so that 64 bits suffice

PARTIAL = "lang string, source string, term string, n long, df long"
_PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])


def slice_counts(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """(lang, source, term, n, df) of some rows. The term '' stands for the group itself and counts its rows."""
    groups = pa.table({"lang": lang, "source": source, "row": pa.array(np.arange(len(text)))})
    own = groups.group_by(["lang", "source"], use_threads=False).aggregate([([], "count_all")])
    marks = pa.table([own["lang"], own["source"], pa.array([""] * len(own)), pa.array(np.zeros(len(own), np.int64)),
                      own["count_all"]], schema=_PARTIAL)
    split = pc.split_pattern_regex(pc.ascii_lower(text), NOT_TERM)
    terms, row = pc.list_flatten(split), pc.list_parent_indices(split)
    full = pc.greater(pc.binary_length(terms), 0)
    coded = pc.filter(terms, full).dictionary_encode()
    if not len(coded):
        return marks
    per_row = pa.table({"row": pc.cast(pc.filter(row, full), pa.int64()), "code": coded.indices})
    per_row = per_row.group_by(["row", "code"], use_threads=False).aggregate([([], "count_all")])
    # rows of one (lang, source) get one number
    of_lang, of_source = (x.dictionary_encode().indices.to_numpy().astype(np.int64) for x in (lang, source))
    _, first, number = np.unique(of_lang * len(text) + of_source, return_index=True, return_inverse=True)
    rows = per_row["row"].to_numpy()
    summed = pa.table({"group": number[rows], "code": per_row["code"], "n": per_row["count_all"]})
    summed = summed.group_by(["group", "code"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    one = pa.array(first[summed["group"].to_numpy()])
    found = pa.table([lang.take(one), source.take(one), coded.dictionary.take(summed["code"].combine_chunks()),
                      summed["n_sum"], summed["n_count"]], schema=_PARTIAL)
    return pa.concat_tables([marks, found])


def merge(tables: list[pa.Table]) -> pa.Table:
    """The sums of some tables of partial counts, rows of one group next to each other."""
    out = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False)
    out = out.aggregate([("n", "sum"), ("df", "sum")]).rename_columns(_PARTIAL.names)
    return out.sort_by([("lang", "ascending"), ("source", "ascending")])


def partial_counts(docs: DataFrame) -> DataFrame:
    """Counts of every partition; a (lang, source, term) may occur in several rows."""
    def count(batches):
        held, rows = [], 0
        for batch in batches:
            lang, source, text = (pc.fill_null(c, "") for c in batch.columns)
            for a, b in W.slices(text, SLICE):
                held.append(slice_counts(lang[a:b], source[a:b], text[a:b]))
                rows += len(held[-1])
                if rows > HELD:
                    held = [merge(held)]
                    rows = len(held[0])
                    if rows > HELD // 2:
                        yield from held[0].to_batches(8192)
                        held, rows = [], 0
        if held:
            yield from merge(held).to_batches(8192)

    picked = docs.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")])
    return picked.mapInArrow(count, PARTIAL)


def term_rows(docs: DataFrame) -> DataFrame:
    """(lang, term, df, sources) with an array of (source, n); one shuffle of the partial counts."""
    dealt = partial_counts(docs).repartition("lang", "term")
    counted = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    # at most one entry for each source of the language
    return counted.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("sources"))


def probability(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * count / total) for count <= total, by long division."""
    out, rest = np.zeros_like(count), count
    for _ in range(3):
        digit, rest = np.divmod(rest * UNIT, total)
        out = out * UNIT + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def best(value: np.ndarray, at: np.ndarray, terms: list[bytes], top: int) -> list[int]:
    """Of the positions ``at`` those of the ``top`` highest values, ties by the terms' bytes."""
    if len(at) > top:
        at = at[value[at] >= np.partition(value[at], len(at) - top)[len(at) - top]]
    return sorted(at.tolist(), key=lambda i: (-value[i], terms[i]))[:top]


def shard_sums(sources: list[str], size: np.ndarray, rows: pa.Table, kept: int, top: int):
    """Of one language: pair sums (source by source) and the leading terms of each source in this shard."""
    place = {s: i for i, s in enumerate(sources)}
    sums, leading = np.zeros((len(sources), len(sources)), np.int64), []
    total = size + 2 * kept
    whole = np.int64(size.sum() + 2 * kept)
    step = max(1, CELLS // len(sources))
    for a in range(0, len(rows), step):
        part = rows.slice(a, step).combine_chunks()
        lists = part["sources"].combine_chunks()
        entry = pc.list_flatten(lists)
        count = np.zeros((len(sources), len(part)), np.int64)
        named = pc.struct_field(entry, "source").dictionary_encode()
        to = np.array([place[s] for s in named.dictionary.to_pylist()], np.int64)
        count[to[named.indices.to_numpy()], pc.list_parent_indices(lists).to_numpy()] = pc.struct_field(entry, "n").to_numpy()
        p = probability(count + 2, total[:, None])
        q = probability(count.sum(0) + 2, whole)
        terms = [t.encode() for t in part["term"].to_pylist()]
        for i in range(len(sources)):
            if i + 1 < len(sources):
                sums[i, i + 1:] += divergence(p[i], p[i + 1:]).sum(1)
            f = divergence(p[i], q)
            leading += [(i, terms[k].decode(), int(f[k]))
                        for k in best(f, np.flatnonzero((count[i] > 0) & (p[i] > q)), terms, top)]
    return sums, leading


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of the columns text, lang and source of ``docs``.

    Part ``pair`` has every other source of the language, part ``term`` the ``top`` terms that the
    source uses more than its language, both by descending divergence.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    terms = term_rows(docs).where((F.col("df") >= least_docs) | (F.col("term") == ""))
    terms = written(terms, "divergence-terms")
    kept = terms.where("term <> ''")
    groups = terms.where("term = ''").select("lang", F.explode("sources").alias("s")).select("lang", F.col("s.source").alias("source"))
    per_group = (kept.select("lang", F.explode("sources").alias("s"))
                 .groupBy("lang", F.col("s.source").alias("source")).agg(F.sum("s.n").alias("size")))
    per_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    groups = (groups.join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left")
              .na.fill(0, ["size", "kept"]))
    n_shards = max(2 * spark.sparkContext.defaultParallelism, -(-kept.count() // SHARD))
    everywhere = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    dealt = kept.select("lang", "term", "sources", F.pmod(F.xxhash64("term"), F.lit(n_shards)).cast("int"))
    dealt = dealt.toDF("lang", "term", "sources", "shard")  # both sides stem from one table: new column identities

    def shard(key, groups, rows):
        out = []
        for lang in sorted(set(groups["lang"].to_pylist())):
            mine = groups.filter(pc.equal(groups["lang"], lang)).sort_by("source")
            own = rows.filter(pc.equal(rows["lang"], lang))
            if not len(own) and key[0].as_py():
                continue  # the first shard speaks for every pair, whatever its terms
            names = mine["source"].to_pylist()
            sums, leading = shard_sums(names, mine["size"].to_numpy(), own, mine["kept"][0].as_py(), top)
            out += [(lang, names[i], "pair", names[j], int(sums[i, j])) for i in range(len(names)) for j in range(i + 1, len(names))]
            out += [(lang, names[i], "term", term, value) for i, term, value in leading]
        columns = list(zip(*out)) or [[]] * 5
        kinds = [pa.string()] * 4 + [pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "part", "item", "value"])

    found = (everywhere.groupBy("shard").cogroup(dealt.groupBy("shard"))
             .applyInArrow(shard, "lang string, source string, part string, item string, value long"))
    found = written(found, "divergence-shards")
    one_way = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    other_way = one_way.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value")
    order = [F.desc("value"), F.asc("item")]
    pairs = one_way.unionByName(other_way)
    ranked = pairs.withColumn("rank", F.row_number().over(_per_group(order)))
    leading = top_per(found.where("part = 'term'"), ["lang", "source"], order, top)
    columns = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    return ranked.select(*columns).unionByName(leading.select(*columns))


def _per_group(order):
    from pyspark.sql.window import Window

    return Window.partitionBy("lang", "source").orderBy(*order)


SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS MATERIALIZED (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
total AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM kept GROUP BY lang),
size AS (SELECT lang, source, sum(n)::BIGINT AS n FROM c GROUP BY lang, source),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.n, 0) + 2 * t.v) AS p,
        1 + (1000000000::HUGEINT * (k.n + 2)) // (t.n + 2 * t.v) AS q
      FROM groups g JOIN kept k USING (lang) JOIN total t USING (lang)
      LEFT JOIN size s ON s.lang = g.lang AND s.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
      FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT lang, source, part, item, value,
  (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r)
WHERE part = 'pair' OR rank <= 10
"""
