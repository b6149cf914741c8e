"""Writers. Every writer leaves one file per partition; single-file wrappers are not forced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meadowlark.functions import vectors as V
from meadowlark.operators.aggregates import vector_range
from meadowlark.operators.ranking import assign_chunks
from meadowlark.operators.search import index_header
from meadowlark.sinks import render


# text formats that keep microseconds
CLOCKS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def write_table(df: DataFrame, fmt: str, path: str, mode: str = "overwrite") -> None:
    """Full table as json, csv (with header) or parquet."""
    writer = df.write.mode(mode).options(**CLOCKS)
    if fmt == "csv":
        writer.csv(path, header=True)
    else:
        writer.format(fmt).save(path)


def write_geojson(org: DataFrame, base_url: str, path: str) -> None:
    """One feature per line."""
    render.to_geojson(org, base_url).select("feature").write.mode("overwrite").text(path)


def write_feature_collections(org: DataFrame, base_url: str, path: str, n: int = 3000) -> None:
    """FeatureCollection documents of at most ``n`` features by id, one file in a folder each."""
    numbered = assign_chunks(render.to_geojson(org, base_url), n)
    listed = numbered.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "feature"))).alias("f"))
    document = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("f", lambda x: x["feature"]), ","), F.lit("]}"))
    _one_file_each(listed.select("chunk", document.alias("value")), path)


def _one_file_each(documents: DataFrame, path: str) -> None:
    """One text file in a folder of its own for every (chunk, value)."""
    documents.repartition("chunk").write.mode("overwrite").partitionBy("chunk").text(path)


def write_icalendar(vevents: DataFrame, path: str, name: str) -> None:
    """Entries by start, in files that read in order; head and foot are the first and last rows."""
    head = "\r\n".join(render.CALENDAR_HEAD).format(name, name)
    spark = vevents.sparkSession
    frame = spark.createDataFrame([(0, head), (2, "END:VCALENDAR")], "part int, line string")
    body = vevents.select(F.lit(1).alias("part"), F.col("vevent").alias("line"), "start_date", "id")
    (frame.unionByName(body, allowMissingColumns=True)
     .orderBy("part", F.col("start_date").asc_nulls_first(), "id").select("line")
     .write.mode("overwrite").option("lineSep", "\r\n").text(path))


def write_sql(df: DataFrame, table: str, path: str, mode: str = "upsert", key: str = "id") -> None:
    """SQL text; a refresh starts with the DELETE."""
    rows = render.sql_statements(df, table, mode, key).select(F.lit(1).alias("part"), "statement", key)
    if mode == "refresh":
        first = df.sparkSession.createDataFrame([(0, f"DELETE FROM {table};")], "part int, statement string")
        rows = first.unionByName(rows, allowMissingColumns=True)
    rows.orderBy("part", key).select("statement").write.mode("overwrite").text(path)


def vector_chunks(vec: DataFrame, n: int = 3000, order=("id",)) -> DataFrame:
    """(pos, chunk, offset, id, lat, lon, lo, hi, e): vectors as codes of the data's own range,
    numbered into chunks; header and codes use the same range."""
    span = vector_range(vec).withColumn("_one", F.lit(1))
    numbered = assign_chunks(vec, n, order).withColumn("_one", F.lit(1))
    ranged = numbered.join(F.broadcast(span), "_one").drop("_one")  # one row
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    codes = F.transform(F.col("embedding").cast("array<double>"),
                        lambda x: F.coalesce(F.round((x - F.col("lo")) / width * 255).cast("int"), F.lit(0)))
    return ranged.select("pos", "chunk", "offset", "id", "lat", "lon", "lo", "hi", V.pack_codes(codes).alias("e"))


def write_chunk_files(vec: DataFrame, path: str, n: int = 3000) -> None:
    """One JSON document per chunk of at most ``n`` vectors: dim, count, offset, range, data."""
    rows = vector_chunks(vec, n)
    listed = rows.groupBy("chunk", "offset", "lo", "hi").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("pos", "id", "lat", "lon", "e"))).alias("d"))
    data = F.transform("d", lambda x: F.struct(x["id"].alias("id"), x["lat"].alias("lat"), x["lon"].alias("lon"), x["e"].alias("e")))
    dim = F.length(F.unbase64(F.get("d", F.lit(0))["e"])).alias("dim")
    document = F.to_json(F.struct(dim, F.col("n").alias("count"), "offset", F.array("lo", "hi").alias("range"), data.alias("data")))
    _one_file_each(listed.select("chunk", document.alias("value")), path)


def write_vector_chunks(vec: DataFrame, path: str, model: str, n: int = 3000) -> None:
    """Chunk folders with one record per line under ``path``/data, the header under ``path``/index."""
    rows = vector_chunks(vec, n).drop("offset")
    rows.repartitionByRange("chunk", "pos").sortWithinPartitions("chunk", "pos").write.mode("overwrite") \
        .partitionBy("chunk").json(f"{path}/data")
    index_header(vec, model, n).write.mode("overwrite").json(f"{path}/index")
