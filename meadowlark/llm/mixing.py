"""Mixing sources to target weights by systematic sampling.

Every source has a target in words. A document's expected copies are its source's target
over its source's size, so they are summed along the documents of the source, in order of
size, one random offset per source is added, and a document is taken once for every
integer that its sum crosses. Neighbours in that order are alike in size, so the words
taken stay near the target. The offset is a hash of seed and source: reruns agree.

Positions inside a source come from range partitions plus one count each, so a source of
any size is spread over all tasks; only ids, sources and sizes are moved.

Defined results: null and empty texts have size 0; a null source is a source of its own,
after all others; a source without words has target 0 and nothing is taken; repeated rows
are documents each, and equal rows share their copies in any order; an empty table gives
an empty result. Extra columns are ignored or, in ``mixed``, passed through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meadowlark.llm.batches import written
from meadowlark.scale import number_rows

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0  # copies of a source
SEED = "mix"
SALTS = 16
BROADCAST_ROWS = 500_000  # of the table of copies, some 60 bytes each


def words(text: Column) -> Column:
    """Number of words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    In ascending order of the factor at which a source is full, a source is full if the
    words left, shared by weight among it and those after it, reach its limit.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    limits = sizes.withColumns({"_weight": F.get(cycle, place), "_limit": F.col("source_size") * F.lit(most)})
    order = [F.col("_limit") / F.col("_weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.col("_total") * F.lit(share) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    full = F.col("_limit") * F.sum("_weight").over(rest) <= F.col("_weight") * left
    judged = limits.withColumn("_total", F.sum("source_size").over(everything)).withColumn("_full", full)
    spent = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_limit"))).over(everything), F.lit(0.0))
    free = F.sum(F.when(~F.col("_full"), F.col("_weight"))).over(everything)
    shared = F.col("_weight") * ((F.col("_total") * F.lit(share) - spent) / free)
    return judged.select("source", "source_size", F.when(F.col("_full"), F.col("_limit")).otherwise(shared).alias("target"))


def _offset(seed: str) -> Column:
    digest = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce("source", F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST,
        seed: str = SEED, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every document."""
    sized = written(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"),
                                words(F.col(f"`{text}`").cast("string")).alias("size")), "mix-sizes")
    placed = number_rows(sized, [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_first()], "_pos")
    sources = placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("_pos").alias("_from"))
    targets = source_targets(sources.select("source", "source_size"), weights, share, most)
    plan = sources.select(F.col("source").alias("_s"), "_from").join(targets, F.col("_s").eqNullSafe(F.col("source")))
    # a hot source meets as many copies of its one row as there are salts
    salted = plan.select("_s", "_from", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    joined = placed.withColumn("_t", F.pmod("_pos", F.lit(SALTS)).cast("int")).join(
        salted, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_t") == F.col("_salt")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = (F.col("_pos") - F.col("_from")).cast("double")
    crossed = (F.floor(F.col("_rate") * (rank + 1) + F.col("_offset")) - F.floor(F.col("_rate") * rank + F.col("_offset")))
    return (
        joined.withColumns({"_rate": rate, "_offset": _offset(seed)})
        .withColumn("copies", F.least(crossed, F.ceil("_rate")).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` with every document as often as the mix takes it.

    Rows that agree in id, source and size share their copies, those with the lower text hash
    first. Texts are moved only for such rows, or if the table of copies is too large to send.
    """
    by = ("_id", "_source", "_size")
    rows = written(mix(docs, key=key, text=text, source=source, **options), "mix-copies")
    copies = rows.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size")).agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("copies").alias("_all")).where("_all > 0")
    if copies.count() <= BROADCAST_ROWS:
        copies = F.broadcast(copies)
    size = words(F.col(f"`{text}`").cast("string"))
    taken = docs.join(copies, F.col(f"`{key}`").eqNullSafe(F.col("_id")) & F.col(f"`{source}`").eqNullSafe(F.col("_source"))
                      & (size == F.col("_size")))
    alone = taken.where("_rows = 1").withColumn("_n", F.col("_all"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(F.col(f"`{text}`"))))
    extra = (place <= F.col("_all") % F.col("_rows")).cast("long")
    alike = taken.where("_rows > 1").withColumn("_n", F.floor(F.col("_all") / F.col("_rows")) + extra).where("_n > 0")
    repeated = alone.unionByName(alike).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return repeated.drop(*by, "_rows", "_all", "_n", "_copy")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), limits AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS lim,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS w,
         sum(source_size) OVER () AS total
  FROM sources
), judged AS (
  SELECT *, lim * sum(w) OVER (ORDER BY lim / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         <= w * (total * 1.5::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / w, source ASC NULLS LAST
                                                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full
  FROM limits
), targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN lim ELSE
         w * ((total * 1.5::DOUBLE - coalesce(sum(lim) FILTER (WHERE is_full) OVER (), 0)) / sum(w) FILTER (WHERE NOT is_full) OVER ()) END AS target,
         ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM judged
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) - 1)::DOUBLE AS k FROM sized
), rated AS (
  SELECT doc_id, size, source_size, target, k, shift, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS r
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * least(floor(r * (k + 1) + shift) - floor(r * k + shift), ceil(r)))::BIGINT AS taken
FROM rated
"""
