"""Aggregations. Each is one pass with map-side partial aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meadowlark.functions import dates
from meadowlark.functions import text as T
from meadowlark.scale import keys_of, list_pages, number_rows

FEATURES = ("accepts_volunteers", "accepts_visitors", "accepts_shortterm", "accepts_longterm", "has_jobs", "has_stays")


def totals(**tables: DataFrame) -> DataFrame:
    """(name, n) row counts of several tables."""
    counted = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, counted)


def count_by(df: DataFrame, col: str) -> DataFrame:
    """Row counts per value; NULL is a group."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def feature_counts(org: DataFrame) -> DataFrame:
    return org.agg(*[F.count_if(F.col(f)).alias(f) for f in FEATURES])


def statistics(org: DataFrame, jobs: DataFrame) -> DataFrame:
    """The statistics document as (section, key, value) rows. Totals, flags and the two group
    counts over organizations come from one scan through grouping sets."""
    grouped = (
        org.groupingSets([[F.col("source")], [F.col("country")], []], F.col("source"), F.col("country"))
        .agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"),
             *[F.count_if(F.col(f)).alias(f) for f in FEATURES])
    )
    whole = F.col("g") == 3
    flags = F.array(*[F.struct(F.lit("feature_counts").alias("section"), F.lit(f).alias("key"),
                               F.col(f).alias("value")) for f in FEATURES])
    total = F.array(F.struct(F.lit("total_organizations").alias("section"), F.lit("").alias("key"),
                             F.col("n").alias("value")))
    group = F.array(F.struct(
        F.when(F.col("g") == 1, "by_source").otherwise("by_country").alias("section"),
        F.coalesce(F.when(F.col("g") == 1, F.col("source")).otherwise(F.col("country")), F.lit("null")).alias("key"),
        F.col("n").alias("value")))
    rows = grouped.select(F.inline(F.when(whole, F.concat(total, flags)).otherwise(group)))
    n_jobs = jobs.agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("total_opportunities").alias("section"), F.lit("").alias("key"), "value")
    return rows.unionByName(n_jobs)


def distinct_parents(df: DataFrame, col: str = "organization_id", approximate: bool = False) -> DataFrame:
    agg = F.approx_count_distinct(col) if approximate else F.count_distinct(F.col(col))
    return df.agg(agg.alias("n"))


def duplicates(df: DataFrame, col: str, key: str = "id") -> DataFrame:
    """Values shared by more than one id, most shared first."""
    return (
        df.where(~T.is_blank(col)).groupBy(col).agg(F.count_distinct(F.col(key)).alias("n"))
        .where(F.col("n") > 1).orderBy(F.col("n").desc(), col)
    )


def representatives(df: DataFrame, key: str, cols: Sequence[str] = ("id", "title", "description")) -> DataFrame:
    return df.where(~T.is_blank(key)).groupBy(key).agg(*[F.min(c).alias(c) for c in cols])


def min_max(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).alias("oldest"), F.max(col).alias("newest"))


def vector_range(vec: DataFrame, col: str = "embedding") -> DataFrame:
    return vec.agg(F.min(F.array_min(col)).cast("double").alias("lo"), F.max(F.array_max(col)).cast("double").alias("hi"))


def group_list(df: DataFrame, key: str, order: Sequence, item: Column, page_size: int = 1000) -> DataFrame:
    """Ordered member lists per key, in pages, so that a hot key never becomes one value."""
    return list_pages(df, [key], order, item, page_size)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return count_by(df, col).orderBy(F.col("n").desc(), col)


def coverage(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, filled, missing, percent) with '' counting as missing."""
    once = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(~T.is_blank(c)).alias(c) for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in cols])
    return once.select("n", F.inline(rows)).select(
        "column", "filled", (F.col("n") - F.col("filled")).alias("missing"), T.pct("filled", "n").alias("percent"))


def progress(org: DataFrame, jobs: DataFrame, stays: DataFrame) -> DataFrame:
    """Counts of a refinement run, one pass per table."""
    done = keys_of(jobs, "organization_id", "id").join(org.where(F.col("jobs_rescraped") == 1).select("id"), "id", "left_semi").agg(
        F.count(F.lit(1)).alias("jobs_done"))
    j = jobs.agg(*[F.count_if(~T.is_blank(c)).alias(a) for c, a in
                   (("skills_needed", "jobs_skills"), ("commitment", "jobs_commitment"), ("application_email", "jobs_email"))])
    s = stays.agg(
        F.count_if(F.col("being_processed_since").isNull() & F.col("price_info").isNotNull()).alias("stays_priced"),
        F.count_if(F.col("stay_type") != "accommodation").alias("stays_typed"))
    long = [f.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in f.columns])))
            for f in (done, j, s)]
    return reduce(DataFrame.unionByName, long)


def merge_by_location(df: DataFrame, generic: Column, digits: int = 4) -> DataFrame:
    """Rows at one rounded position become one: real names before generic ones, then the lowest
    id; sources, source_urls and tags are united, those that the rows have. A value counts once at
    a position, and is reduced to that before it is shuffled."""
    lists = [c for c in ("sources", "source_urls", "tags") if c in df.columns]
    placed = df.select("id", "name", *lists, F.round("lat", digits).alias("_lat"), F.round("lng", digits).alias("_lng"),
                       generic.cast("int").alias("_generic"))
    best = F.min_by(F.struct("id", "name"), F.struct(F.col("_generic").alias("g"), F.col("id").alias("i")))
    out = placed.groupBy("_lat", "_lng").agg(best.alias("_best"), F.count_distinct("id").alias("n_merged"))
    for c in lists:
        values = placed.select(F.col("_lat").alias("_a"), F.col("_lng").alias("_b"), F.explode(c).alias("_value")).distinct()
        sets = values.groupBy("_a", "_b").agg(F.array_sort(F.collect_list("_value")).alias(c))
        out = out.join(sets, F.col("_lat").eqNullSafe(F.col("_a")) & F.col("_lng").eqNullSafe(F.col("_b")), "left").drop("_a", "_b")
    united = [F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in lists]
    return out.select(F.col("_best.id").alias("id"), F.col("_best.name").alias("name"), F.col("_lat").alias("lat"),
                      F.col("_lng").alias("lng"), *united, "n_merged")


def distribution(df: DataFrame, col: str, n: int = 20) -> DataFrame:
    return count_by(df, col).orderBy(F.col("n").desc(), F.col(col)).limit(n)


def bounds(df: DataFrame) -> DataFrame:
    """Bounding box and centre of the points."""
    box = df.agg(F.min("latitude").alias("south"), F.max("latitude").alias("north"),
                 F.min("longitude").alias("west"), F.max("longitude").alias("east"))
    return box.select("*", ((F.col("south") + F.col("north")) / 2).alias("center_lat"),
                      ((F.col("west") + F.col("east")) / 2).alias("center_lon"))


def assign_ids(new: DataFrame, existing: DataFrame, order: Sequence, key: str = "id") -> DataFrame:
    """New rows numbered from the largest existing id on."""
    top = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    numbered = number_rows(new, order, "_pos").withColumn("_one", F.lit(1))
    return (
        numbered.join(F.broadcast(top.withColumn("_one", F.lit(1))), "_one")  # one row
        .withColumn(key, F.col("_top") + 1 + F.col("_pos")).drop("_pos", "_one", "_top")
    )


def retention_stats(df: DataFrame, now, col: str = "enriched_at", days: int = 90) -> DataFrame:
    cutoff = dates.moment(now) - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.agg(F.count(F.lit(1)).alias("total"), F.min(col).alias("oldest"), F.max(col).alias("newest"),
                  F.count_if(F.col(col) < cutoff).alias("over_age"))
