"""Ranking, numbering and grouping that survive hot keys.

A key may hold a third of all rows, so nothing here gathers a whole group in one
task: top-n ranks are cut per partition before the shuffle, numbering works on
range partitions, and lists are emitted in pages of bounded length.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meadowlark.session import durable

BLOCK_ROWS = 8192
LARGE_KEY = 100_000  # rows of a key that one task may sort
_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above this bit


def top_per(df: DataFrame, keys: Sequence, order: Sequence, n: int, rank: str = "rank") -> DataFrame:
    """The n first rows of every key. ``rank <= n`` lets Spark cut each partition
    to n rows per key before shuffling (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def first_per(df: DataFrame, keys: Sequence, order: Sequence) -> DataFrame:
    """The first row of every key."""
    return top_per(df, keys, order, 1, "_first").drop("_first")


def number_rows(df: DataFrame, order: Sequence, name: str = "pos") -> DataFrame:
    """Zero-based positions in a total order, without a single-partition window.

    Rows are range-partitioned, sorted locally and numbered inside their partition;
    one count per partition then gives each partition its offset.
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    slotted = durable(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_slot", _ROW_BITS))
    )
    sizes = slotted.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.col("_slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    # starts has one row per partition, so it is small by construction
    return slotted.join(F.broadcast(starts), "_part").select(*cols, (F.col("_start") + local).alias(name))


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence, name: str = "rank",
                count: str | None = None) -> DataFrame:
    """One-based rank inside each key for keys of any size.

    Positions come from ``number_rows`` on (keys, order); the smallest position of a
    key is its start. The join back to the starts is an equi-join whose large side
    adaptive execution may split.
    """
    numbered = number_rows(df, [F.col(k) for k in keys] + list(order), "_pos")
    starts = numbered.groupBy(*keys).agg(F.min("_pos").alias("_from"), F.count(F.lit(1)).alias("_size"))
    renamed = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_from", "_size")
    on = _same_keys(keys, [f"_k{i}" for i in range(len(keys))])
    out = numbered.join(renamed, on).withColumn(name, F.col("_pos") - F.col("_from") + 1)
    if count:
        out = out.withColumn(count, F.col("_size"))
    return out.drop("_pos", "_from", "_size", *[f"_k{i}" for i in range(len(keys))])


def _same_keys(left: Sequence[str], right: Sequence[str]) -> Column:
    on = F.lit(True)
    for a, b in zip(left, right):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def list_pages(df: DataFrame, keys: Sequence[str], order: Sequence, item: Column,
               page_size: int = 1000, large_key: int = LARGE_KEY) -> DataFrame:
    """Ordered lists per key, in pages of at most ``page_size`` items.

    Every item appears; a key with many rows simply has many pages, so no row ever
    holds more than one page. Columns: keys, page (from 0), n_items (of the key), items. All
    columns of ``df`` are shuffled, so pass only those that keys, order and item need.

    Keys are counted first, reduced before they are shuffled. Those of up to ``large_key`` rows,
    usually all, are ranked, counted and listed by one exchange, in sorts that may spill; only
    the rows of the others are ranked over range partitions.
    """
    named = df.withColumn("_item", item)
    renamed = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    on = _same_keys(keys, [f"_k{i}" for i in range(len(keys))])
    large = durable(named.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > large_key).select(*renamed))
    many = not large.isEmpty()
    own = Window.partitionBy(*keys)
    ranked = named.join(large, on, "left_anti") if many else named
    ranked = ranked.withColumn("_rank", F.row_number().over(own.orderBy(*order))).withColumn("n_items", F.count(F.lit(1)).over(own))

    def paged(rows):
        page = F.floor((F.col("_rank") - 1) / page_size).cast("long").alias("page")
        lists = rows.groupBy(*keys, page).agg(F.first("n_items").alias("n_items"), F.array_sort(F.collect_list(F.struct("_rank", "_item"))).alias("_sorted"))
        return lists.select(*keys, "page", "n_items", F.transform("_sorted", lambda x: x["_item"]).alias("items"))

    if not many:
        return paged(ranked)
    return paged(ranked).unionByName(paged(rank_within(named.join(large, on, "left_semi"), keys, order, "_rank", "n_items")))


def keys_of(df: DataFrame, col, name: str) -> DataFrame:
    """The distinct non-null values of a column, as the right side of a semi or anti join: a hot
    value is reduced to one row before it is shuffled, and the join reuses that partitioning."""
    value = F.col(col) if isinstance(col, str) else col
    return df.select(value.alias(name)).where(F.col(name).isNotNull()).distinct()


def meet_in_blocks(left: DataFrame, right: DataFrame, left_key: str, right_key: str, fn: Callable, schema: str,
                   on: Sequence[str] = (), rows: int = BLOCK_ROWS) -> DataFrame:
    """``fn`` over every pair of a block of ``left`` and a block of ``right``, as Arrow tables.

    For tests of all rows against all that no equi-join expresses. Both sides stay in the
    executors; a block has about ``rows`` rows, and ``on`` names columns that must agree, which
    keeps most blocks apart. ``fn`` should return a few rows per left row. ``right`` falls into
    two blocks a core at least, so that every core has work.
    """
    cores = left.sparkSession.sparkContext.defaultParallelism
    n_left = max(1, -(-left.count() // rows))
    n_right = max(2 * cores, -(-right.count() // rows))

    def dealt(df: DataFrame, key: str, own: str, n_own: int, other: str, n_other: int):
        placed = df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))).groupBy(*on, "_left", "_right")

    mine = dealt(left, left_key, "_left", n_left, "_right", n_right)
    theirs = dealt(right, right_key, "_right", n_right, "_left", n_left)
    return mine.cogroup(theirs).applyInArrow(lambda a, b: fn(a, b), schema)
