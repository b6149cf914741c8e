"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meadowlark.functions import text as T
from meadowlark.scale import keys_of


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def except_ids(base: DataFrame, keep: DataFrame, key: str = "id") -> DataFrame:
    return base.join(keys_of(keep, key, key), key, "left_anti")


def tokens(c) -> Column:
    """Distinct lower-case ASCII words."""
    spaced = F.regexp_replace(F.lower(T.col(c)), "[^a-z]", " ")
    return F.array_distinct(F.filter(F.split(spaced, " +"), lambda w: w != ""))


def token_overlap(a, b) -> Column:
    return F.array_intersect(tokens(a), tokens(b))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.where(~T.is_blank(col)).select(col).distinct()
