"""Token totals by source, language and tokenizer version, kept up to date by deltas.

Totals are sums of signed rows: an insert adds a document and its tokens, a delete takes
them away, a revised count does both. A batch of deltas is summed, written aside and moved
under its own name when it is whole; a name that is already committed is not written again,
so a retried batch counts once, as does one that two writers commit at the same time, and a
half-written one is replaced.

The rollup is a snapshot of the totals and the batches it holds. ``compact`` adds the batches
committed since to the snapshot before and writes the next; ``totals`` reads the last whole
snapshot and the batches after it, never the ledger from its beginning. Only names of batches
come to the driver.

Defined results: null and empty texts count no tokens but are documents; null sources and
languages are groups of their own; repeated rows count each; groups whose documents and
tokens cancel out are left away; an empty ledger has no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from meadowlark.llm import words as W
from meadowlark.llm.batches import bound_batches, process_cache

GROUP = ("source", "lang", "tokenizer")


def _encoding(rank_file: bytes, pattern: str):
    made, key = process_cache(), ("counter", zlib.crc32(rank_file), pattern)
    if key not in made:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_file.splitlines() if x)}
        made[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return made[key]


def token_count(spark: SparkSession, path: str, pattern: str):
    """A column function that counts the tokens of a text with a tiktoken rank file."""
    bound_batches(spark)
    held = spark.sparkContext.broadcast(Path(path).read_bytes())

    @F.arrow_udf(LongType())
    def count(texts: pa.Array) -> pa.Array:
        encoding = _encoding(held.value, pattern)
        out = [len(encoding.encode_ordinary(t)) if t else 0
               for a, b in W.slices(texts, W.SEGMENT) for t in texts[a:b].to_pylist()]
        return pa.array(np.array(out, np.int64))

    return lambda text: count(F.col(text).cast("string"))


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Count rows (source, lang, tokenizer, tokens) as inserts (1) or deletes (-1)."""
    return counts.select(*GROUP, F.lit(sign).cast("long").alias("n_docs"),
                         (F.coalesce("tokens", F.lit(0)) * sign).cast("long").alias("n_tokens"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """The deltas that turn one set of counts into another."""
    return signed(before, -1).unionByName(signed(after, 1))


def _sums(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def _files(spark: SparkSession, ledger: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(ledger).getFileSystem(spark._jsc.hadoopConfiguration())


def _whole(spark: SparkSession, ledger: str, stem: str) -> list[str]:
    """What follows ``stem`` in the names of the ledger's finished folders."""
    path, fs = _files(spark, ledger)
    if not fs.exists(path(ledger)):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(path(ledger))]
    return sorted(n[len(stem):] for n in names if n.startswith(stem) and fs.exists(path(f"{ledger}/{n}/_SUCCESS")))


def _publish(df: DataFrame, ledger: str, name: str) -> bool:
    """``df`` written aside and moved to its name; False if that is taken by a whole folder. A folder
    that comes second is moved below the first, where an underscore hides it from readers."""
    spark = df.sparkSession
    path, fs = _files(spark, ledger)
    target, aside = path(f"{ledger}/{name}"), f"{ledger}/_aside-{uuid.uuid4().hex}"
    df.write.parquet(aside)
    if fs.exists(path(f"{ledger}/{name}/_SUCCESS")):
        return False
    if fs.exists(target):
        fs.delete(target, True)  # half-written
    return fs.rename(path(aside), target) and not fs.exists(path(f"{ledger}/{name}/{aside.rsplit('/', 1)[1]}"))


def commit(deltas: DataFrame, ledger: str, batch: str) -> bool:
    """Add a batch to the ledger once. False if it was there already."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError(f"batch name {batch!r}")
    path, fs = _files(deltas.sparkSession, ledger)
    if fs.exists(path(f"{ledger}/batch={batch}/_SUCCESS")):
        return False
    return _publish(_sums(deltas), ledger, f"batch={batch}")


def _snapshot(spark: SparkSession, ledger: str) -> tuple[int, list[str]]:
    """The number of the last whole snapshot and the batches in it; 0 and none before the first."""
    numbers = [int(n) for n in _whole(spark, ledger, "_totals-")]
    if not numbers:
        return 0, []
    names = spark.read.schema("batch string").parquet(f"{ledger}/_batches-{max(numbers)}")
    return max(numbers), [r[0] for r in names.collect()]


def _current(spark: SparkSession, ledger: str) -> tuple[DataFrame, int, list[str], list[str]]:
    number, held = _snapshot(spark, ledger)
    later = sorted(set(_whole(spark, ledger, "batch=")) - set(held))
    parts = [f"{ledger}/_totals-{number}"] * bool(number) + [f"{ledger}/batch={b}" for b in later]
    rows = spark.read.schema(_SCHEMA).parquet(*parts) if parts else spark.createDataFrame([], _SCHEMA)
    return _sums(rows).where("n_docs <> 0 OR n_tokens <> 0"), number, held, later


def compact(spark: SparkSession, ledger: str) -> bool:
    """Write the next snapshot, if batches came since the last. Its names are written first, so a
    snapshot that is whole has them."""
    rows, number, held, later = _current(spark, ledger)
    if not later:
        return False
    spark.createDataFrame([(b,) for b in held + later], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{ledger}/_batches-{number + 1}")
    return _publish(rows.coalesce(1), ledger, f"_totals-{number + 1}")


def totals(spark: SparkSession, ledger: str) -> DataFrame:
    """The current totals over all committed batches."""
    return _current(spark, ledger)[0]
