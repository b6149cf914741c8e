"""Ranking, first-per-key, chunking, ordering and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meadowlark.functions import dates
from meadowlark.functions import text as T
from meadowlark.operators import filters
from meadowlark.scale import first_per, number_rows, top_per


def top_k(df: DataFrame, k: int, score: str = "score", tie: str = "id") -> DataFrame:
    return df.orderBy(F.col(score).desc(), F.col(tie)).limit(k)


def rank_results(df: DataFrame, k: int, score: str = "score", tie: str = "id") -> DataFrame:
    """Dense ranks 1..k of the k best; the window runs over those k rows only."""
    w = Window.orderBy(F.col(score).desc(), F.col(tie))
    return top_k(df, k, score, tie).withColumn("rank", F.row_number().over(w))


def rank_percent(df: DataFrame, order: Sequence) -> DataFrame:
    """Rank and a percentage falling from 99 to 5 over a result of any size."""
    numbered = number_rows(df, order, "_idx")
    n = numbered.agg(F.count(F.lit(1)).alias("total")).withColumn("_one", F.lit(1))
    share = F.col("_idx") / (F.col("total") - 1)
    return (
        numbered.withColumn("_one", F.lit(1)).join(F.broadcast(n), "_one")  # one row
        .withColumn("rank", F.col("_idx") + 1)
        .withColumn("pct", F.when(F.col("total") > 1, F.floor(5 + 94 * (1 - share) + 0.5)).otherwise(99).cast("int"))
        .drop("_idx", "_one")
    )


def dedupe_first(df: DataFrame, key, order: Sequence, partition: Sequence = (),
                 key_len: int | None = None) -> DataFrame:
    """First row per normalized key (within ``partition``); rows with a blank key all stay.

    ``order`` must tell rows apart: a blank key is completed by it, which keeps such rows and
    spreads them instead of gathering them under one key. One scan, cut before the shuffle.
    ``key_len`` compares the first characters only. Keys travel as digests.
    """
    k = F.lower(T.strip(F.coalesce(T.col(key), F.lit(""))))
    k = k if key_len is None else T.prefix(k, key_len)
    keyed = df.withColumn("_key", F.when(k == "", k).otherwise(F.sha2(k, 256))).withColumn("_own", F.when(F.col("_key") == "", F.struct(*order)))
    return first_per(keyed, [*partition, "_key", "_own"], order).drop("_key", "_own")


def calendar_month(events: DataFrame, year: int, month: int, n: int = 3) -> DataFrame:
    """The first n events of each day with a clock label and how many more the day has.

    The shown rows and the day counts are separate aggregates, so both are cut map-side.
    """
    day = F.to_date("start_date")
    inside = filters.in_period(events, year, month).withColumn("day", day)
    shown = top_per(inside, ["day"], [F.col("start_date"), F.col("id")], n, "slot")
    counts = inside.groupBy(F.col("day").alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    return (
        shown.join(counts, F.col("day") == F.col("_day"))
        .withColumn("clock", dates.clock12("start_date"))
        .withColumn("more", F.greatest(F.col("_n") - n, F.lit(0)))
        .drop("_day", "_n")
    )


def assign_chunks(df: DataFrame, n: int = 3000, order: Sequence = ("id",)) -> DataFrame:
    """Chunk number and the offset of its first row, by position in a total order."""
    numbered = number_rows(df, [F.col(o) if isinstance(o, str) else o for o in order])
    chunk = F.floor(F.col("pos") / n).cast("long")
    return numbered.withColumn("chunk", chunk).withColumn("offset", chunk * n)


def fill_unique(df: DataFrame) -> DataFrame:
    """Blank websites take their directory URL unless it is in use; the first id claims a URL."""
    used = df.where(~T.is_blank("website")).select(F.col("website").alias("_used"))
    url = F.trim(F.col("directory_url"))
    want = df.where(T.is_blank("website") & ~T.is_blank("directory_url")).select("id", url.alias("_url"))
    claims = first_per(want.join(used, F.col("_url") == F.col("_used"), "left_anti"), ["_url"], [F.col("id")])
    claims = claims.withColumnRenamed("id", "_id")
    return (
        df.join(claims, F.col("id") == F.col("_id"), "left")
        .withColumn("website", F.coalesce(F.col("_url"), F.col("website"))).drop("_id", "_url")
    )


def tiered_rank(df: DataFrame, cap: int, first: Column, then: Column, query: str = "query_id",
                tie: str = "retrieval_rank") -> DataFrame:
    """The first ``cap`` retrieved rows are ordered by ``first``, all others after them by ``then``;
    equal scores keep their retrieval order.
    Rows per query are a retrieval result, so a query's window is bounded by the retrieval cut."""
    tier = (F.col("retrieval_rank") > cap).cast("int")
    scored = df.withColumn("_tier", tier).withColumn("score", F.when(tier == 0, first).otherwise(then))
    w = Window.partitionBy(query).orderBy("_tier", F.col("score").desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(w)).drop("_tier")


def paginate(df: DataFrame, skip: int = 0, limit: int = 100, order: Sequence = ("id",)) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(limit)


def order_by_start(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("start_date").asc_nulls_first(), F.col("id"))


def order_by_priority(df: DataFrame, cond: Column) -> DataFrame:
    """Rows meeting the condition first."""
    return df.orderBy(F.when(cond, 0).otherwise(1), F.col("id"))


def newest_first(df: DataFrame, col: str, tie: str = "id") -> DataFrame:
    return df.orderBy(F.col(col).desc(), F.col(tie))
