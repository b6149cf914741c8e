"""Typed readers for tables and file formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from meadowlark import schemas
from meadowlark.functions import vectors as V
from meadowlark.sources.json_splits import json_objects


def read_table(spark: SparkSession, path: str, schema: StructType | None = None, cols: Sequence[str] | None = None,
               fmt: str = "parquet") -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.format(fmt).load(path)
    return df if cols is None else df.select(*cols)


def read_json(spark: SparkSession, path: str, schema: StructType, one_per_line: bool = False) -> DataFrame:
    """Records from JSON array files: one array a file, which any number of tasks read, or one a line."""
    if not one_per_line:
        return json_objects(spark, path).select(F.from_json("value", schema).alias("r")).select("r.*")
    arrays = spark.read.text(path).select(F.from_json("value", ArrayType(schema)).alias("a"))
    return arrays.select(F.inline("a"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.PAGES)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Flat rows from FeatureCollection files, from bare lists of features, or from features one
    after the other. Files of any size are read by many tasks."""
    one = json_objects(spark, path, "features").select(F.from_json("value", schemas.FEATURE).alias("f")).where(F.col("f.geometry").isNotNull())
    point = F.col("f.geometry.coordinates")
    return one.select("f.properties.*", F.get(point, F.lit(1)).alias("latitude"), F.get(point, F.lit(0)).alias("longitude"))


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """Flat rows from files with one feature per line; these split across tasks."""
    raw = spark.read.schema(schemas.FEATURE).json(path)
    point = F.col("geometry.coordinates")
    return raw.select("properties.*", F.get(point, F.lit(1)).alias("latitude"), F.get(point, F.lit(0)).alias("longitude"))


def read_vector_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Rows of chunk files: global position, id, point and the vector restored from its codes."""
    raw = spark.read.schema(schemas.VECTOR_CHUNK).option("multiLine", True).json(path)
    rows = raw.select("offset", "range", F.posexplode("data").alias("i", "d")).select(
        (F.col("offset") + F.col("i")).alias("pos"), F.col("d.id").alias("id"), F.col("d.lat").alias("lat"),
        F.col("d.lon").alias("lon"), "range", V.unpack_codes(F.col("d.e")).alias("codes"))
    lo, hi = F.get("range", F.lit(0)), F.get("range", F.lit(1))
    return rows.withColumn("embedding", F.transform("codes", lambda b: b * (hi - lo) / 255 + lo)).drop("range")


def read_vector_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same from chunk folders with one record per line (see the matching sink)."""
    raw = spark.read.schema("pos bigint, id bigint, lat double, lon double, lo double, hi double, e string, chunk bigint").json(path)
    codes = raw.withColumn("codes", V.unpack_codes(F.col("e")))
    return codes.withColumn("embedding", F.transform("codes", lambda b: b * (F.col("hi") - F.col("lo")) / 255 + F.col("lo")))
