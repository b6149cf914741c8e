"""Place names: which country values a continent or country name allows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meadowlark import constants as K

SCHEMA = "place string, resolved string, is_continent boolean, allowed string, short boolean"


def gazetteer(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """One row per (place, allowed country value).

    ``place`` is lower-case; ``resolved`` is the continent name or the country code;
    ``allowed`` an upper-case country value. ``extra`` (country name, code, continent) adds
    countries beyond the built-in table.
    """
    rows = [(c.lower(), c, True, c.upper(), False) for c in dict.fromkeys(continent for continent, _, _ in K.COUNTRIES)]
    for continent, code, names in K.COUNTRIES:
        for name in (code.lower(), *names):
            if name != continent.lower():
                rows.append((name, code, False, code, len(name) == 2))
            rows.append((continent.lower(), continent, True, name.upper(), False))
    built = spark.createDataFrame(list(dict.fromkeys(rows)), SCHEMA)
    if extra is None:
        return built
    return built.unionByName(from_countries(extra)).distinct()


def from_countries(countries: DataFrame) -> DataFrame:
    """A gazetteer from a (name, code, continent) table."""
    up = F.upper(F.trim("name"))
    country = countries.select(F.lower(F.trim("name")).alias("place"), F.col("code").alias("resolved"),
                               F.lit(False).alias("is_continent"), F.upper("code").alias("allowed"),
                               F.lit(False).alias("short"))
    continent = countries.select(F.lower("continent").alias("place"), F.col("continent").alias("resolved"),
                                 F.lit(True).alias("is_continent"), F.explode(F.array(up, F.upper("code"))).alias("allowed"),
                                 F.lit(False).alias("short"))
    return country.unionByName(continent).distinct()


def keywords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, w) for i, w in enumerate(K.SUBMISSION_KEYWORDS)], "pos int, keyword string")


def fixed_locations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.FIXED_LOCATIONS, "name string, country string, focus string, lat double, lon double")
