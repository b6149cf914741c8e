"""Anonymizing, retention and erasure."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meadowlark.functions import dates
from meadowlark.functions import text as T
from meadowlark.scale import keys_of
from meadowlark.sinks.files import write_table

LOCAL_ADDRESSES = ("127.0.0.1", "::1", "0.0.0.0")


def anonymize_ip(c) -> Column:
    """Last IPv4 octet zeroed; local and other addresses as they are."""
    ip = T.col(c)
    v4 = ip.rlike(r"^[^.]*\.[^.]*\.[^.]*\.[^.]*$") & ~ip.isin(*LOCAL_ADDRESSES)
    return F.when(v4, F.regexp_replace(ip, r"\.[^.]*$", ".0")).otherwise(ip)


def purge(df: DataFrame, col: str, now, days: int = 180) -> DataFrame:
    """Without rows older than the retention period; rows without a time stay."""
    cutoff = dates.moment(now) - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.where((F.col(col) >= cutoff) | F.col(col).isNull())


def purge_counts(df: DataFrame, col: str, now, days: int = 180) -> DataFrame:
    cutoff = dates.moment(now) - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.agg(F.count_if(F.col(col) < cutoff).alias("purged"), F.count(F.lit(1)).alias("total"))


def erase(df: DataFrame, key: str, subjects: DataFrame) -> DataFrame:
    """Without the rows of the given subjects."""
    return df.join(keys_of(subjects, key, key), key, "left_anti")


def erased_any(df: DataFrame, key: str, subjects: DataFrame) -> DataFrame:
    """Per subject, whether it had any row."""
    found = keys_of(df, key, "_k")
    return keys_of(subjects, key, key).join(found, F.col(key) == F.col("_k"), "left").select(
        key, F.col("_k").isNotNull().alias("erased"))


class Erased(NamedTuple):
    rows: DataFrame
    report: DataFrame


def erase_all(df: DataFrame) -> Erased:
    """The emptied table, and one row with the number of rows that were in it."""
    return Erased(df.limit(0), df.agg(F.count(F.lit(1)).alias("erased")))


def export_csv(df: DataFrame, path: str, col: str = "enriched_at") -> None:
    write_table(df.orderBy(F.col(col).desc()), "csv", path)
