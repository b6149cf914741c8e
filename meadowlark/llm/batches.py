"""Small helpers around Arrow batches in tasks."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from meadowlark.session import ensure_checkpoint_dir

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts cross to Python in batches of at most ``rows`` rows of this session."""
    if int(spark.conf.get(_ROWS, "10000")) > rows:
        spark.conf.set(_ROWS, str(rows))


def process_cache() -> dict:
    """What a Python worker keeps from task to task. Module globals do not: the functions of this
    package travel to the workers by value and bring new globals with every task."""
    home = sys.modules.setdefault("meadowlark_process_cache", types.ModuleType("meadowlark_process_cache"))
    return home.__dict__.setdefault("held", {})


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name, i = stem, 0
    while name.lower() in taken:
        name, i = f"{stem}{i}", i + 1
    return name


def append_columns(df: DataFrame, source: str, fn: Callable[[pa.Array], list], results: dict[str, str]) -> DataFrame:
    """``df`` with the columns of ``results`` that ``fn`` gives for a batch of the string column ``source``.

    Only ``source`` crosses to Python. Columns of ``df`` named as a result are replaced.
    """
    schema = StructType(_parse_datatype_string(", ".join(f"{k} {v}" for k, v in results.items())).fields)

    @F.arrow_udf(schema)
    def facts(texts: pa.Array) -> pa.Array:
        kinds = [pa_type(f.dataType) for f in schema.fields]
        columns = [pa.array(x, kind) for x, kind in zip(fn(texts), kinds)]
        return pa.StructArray.from_arrays(columns, names=list(results))

    name = free_name(df, "_facts")
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in {k.lower() for k in results}]
    # not called deterministic, so that a filter on a result is not pushed below and evaluates it again
    got = df.withColumn(name, facts.asNondeterministic()(F.col(f"`{source}`").cast("string")))
    return got.select(*kept, *[F.col(name)[k].alias(k) for k in results])


def pa_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def scratch(spark: SparkSession, stem: str) -> str:
    """A new path in the shared checkpoint folder, for a table that later steps read again."""
    return f"{ensure_checkpoint_dir(spark)}/{stem}-{uuid.uuid4().hex}"


def written(df: DataFrame, stem: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there, so losing an
    executor costs no recomputation, and later reads take only the columns they need."""
    path = scratch(df.sparkSession, stem)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
