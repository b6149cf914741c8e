"""Changes to tables, written as DataFrame rewrites."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meadowlark.functions import dates
from meadowlark.functions import text as T
from meadowlark.operators import filters
from meadowlark.scale import keys_of
from meadowlark.session import durable


def evolve_schema(df: DataFrame, target) -> DataFrame:
    """Missing columns of the target schema added as NULL; nothing is dropped."""
    have = set(df.columns)
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in target.fields if f.name not in have])


def last_per_key(delta: DataFrame, key: str, order: Sequence = ()) -> DataFrame:
    """One row of every key: the last by ``order``; of equal ones the one whose values sort last. Rows
    without a key all stay. One aggregation, so a hot key is reduced before it is shuffled."""
    rest = [c for c in delta.columns if c != key]
    if not rest:
        return delta.distinct()
    keyed = delta.where(F.col(key).isNotNull())
    best = F.max_by(F.struct(*rest), F.struct(*order, *[F.col(c).cast("string") for c in rest]))
    one = keyed.groupBy(key).agg(best.alias("_row")).select(*[F.col(f"_row.{c}").alias(c) if c != key else F.col(key) for c in delta.columns])
    return one.unionByName(delta.where(F.col(key).isNull()))


def upsert(base: DataFrame, delta: DataFrame, key: str = "id", order: Sequence = ()) -> DataFrame:
    """Delta rows replace or extend the base, one row per key: of several the last by ``order``.
    All other base rows stay."""
    return base.join(keys_of(delta, key, key), key, "left_anti").unionByName(last_per_key(delta, key, order))


BUCKET = "_bucket"


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int"))


def write_buckets(df: DataFrame, path: str, key: str = "id", buckets: int = 256) -> None:
    """A table in folders by the hash of its key, which ``upsert_buckets`` changes one by one."""
    dealt = _bucketed(df, key, buckets).withColumn("_n", F.lit(buckets))
    dealt.repartition(BUCKET).write.mode("overwrite").partitionBy("_n", BUCKET).parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_n", BUCKET)


def upsert_buckets(spark: SparkSession, path: str, delta: DataFrame, key: str = "id", order: Sequence = ()) -> None:
    """``upsert`` into a table of ``write_buckets``: only the folders that hold a key of the delta are
    read and written. They are swapped when the job commits, so a failed run leaves the old ones;
    the same delta again changes nothing."""
    stored = spark.read.parquet(path)
    buckets = stored.select("_n").first()[0]
    one = durable(_bucketed(last_per_key(delta, key, order), key, buckets))
    touched = [r[0] for r in one.select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
    old = stored.where(F.col(BUCKET).isin(touched)).select(*delta.columns, BUCKET)
    changed = durable(old.join(keys_of(one, key, key), key, "left_anti").select(*delta.columns, BUCKET).unionByName(one))
    (changed.withColumn("_n", F.lit(buckets)).repartition(BUCKET).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("_n", BUCKET).parquet(path))


def refresh(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def replace_children(old: DataFrame, new: DataFrame, fk: str = "organization_id") -> DataFrame:
    """A parent's children are replaced only if it has new ones."""
    return old.join(keys_of(new, fk, fk), fk, "left_anti").unionByName(new, allowMissingColumns=True)


def update_if(df: DataFrame, delta: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """Columns take the delta's non-blank value (``new_<column>``) where their rule holds."""
    renamed = delta.select(F.col(key).alias("_key"), *[F.col(c).alias(f"new_{c}") for c in rules])
    joined = df.join(renamed, F.col(key) == F.col("_key"), "left")
    types = dict(df.dtypes)

    def updated(c):
        new = F.col(f"new_{c}")
        present = ~T.is_blank(new) if types[c] == "string" else new.isNotNull()
        return F.when(present & F.coalesce(rules[c], F.lit(False)), new).otherwise(F.col(c))

    return joined.select(*[updated(c).alias(c) if c in rules else F.col(c) for c in df.columns])


def fill_website(df: DataFrame) -> DataFrame:
    return df.withColumn("website", F.coalesce(*[T.blank_to_null(c) for c in
                                                 ("website", "direct_website", "directory_url")]))


def null_out(df: DataFrame, col: str, bad: Sequence[str], same_as: str | None = None) -> DataFrame:
    """Listed values become NULL, as do values equal to another column."""
    value = F.when(F.col(col).isin(list(bad)), F.lit(None)).otherwise(F.col(col))
    if same_as is not None:
        value = F.nullif(value, F.col(same_as))
    return df.withColumn(col, value)


def merge_sources(dfs: Sequence[DataFrame], policy: Sequence[str], key: str) -> DataFrame:
    """Attributes of several sources merged in order. 'fill' adds only what is still blank,
    'override' replaces by any non-blank value. One union and one aggregation: each row carries
    its source position, and the winner per column is the value with the best precedence."""
    types = {}
    for d in dfs:
        for c, t in d.dtypes:
            types.setdefault(c, t)
    cols = [c for c in types if c != key]
    parts = []
    for i, d in enumerate(dfs):
        # later overrides outrank everything before them; later fills rank below everything before
        rank = -(i + 1) if policy[i] == "override" else i + 1
        have = set(d.columns)
        parts.append(d.select(F.col(key), F.lit(rank).alias("_rank"),
                              *[(F.col(c) if c in have else F.lit(None)).cast(types[c]).alias(c) for c in cols]))
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    return stacked.groupBy(key).agg(*[
        F.min_by(F.col(c), F.when(~T.is_blank(c) if types[c] == "string" else F.col(c).isNotNull(), F.col("_rank")))
        .alias(c) for c in cols])


def derive_flags(org: DataFrame, jobs: DataFrame, stays: DataFrame, events: DataFrame, now) -> DataFrame:
    """has_* flags from the presence of children, with the attempt time."""
    out = org.drop("has_jobs", "has_stays", "has_events", "last_scrape_attempt")
    for child, flag in ((jobs, "has_jobs"), (stays, "has_stays"), (events, "has_events")):
        owners = keys_of(child, "organization_id", "_owner")
        out = out.join(owners, F.col("id") == F.col("_owner"), "left").withColumn(
            flag, F.col("_owner").isNotNull()).drop("_owner")
    return out.withColumn("last_scrape_attempt", dates.moment(now))


def append(base: DataFrame, new: DataFrame, now=None) -> DataFrame:
    """New rows with false flags where they have none, and creation times."""
    types = dict(base.dtypes)
    have = set(new.columns)
    filled = new
    for flag in filters.FLAGS:
        if flag in types:
            value = F.coalesce(F.col(flag), F.lit(False)) if flag in have else F.lit(False)
            filled = filled.withColumn(flag, value)
    if now is not None:
        for c in ("created_at", "last_updated"):
            if c in types:
                filled = filled.withColumn(c, dates.moment(now))
    return base.unionByName(filled.select(*[c for c in filled.columns if c in types]), allowMissingColumns=True)


def better_description(old, new, name, placeholder: str, min_len: int = 120) -> Column:
    """The new text if it is long enough and longer than the old one or the old one is a
    placeholder; then led by the name unless it starts with it."""
    o, n, nm = T.col(old), T.col(new), T.col(name)
    was_placeholder = F.coalesce(o.contains(placeholder), F.lit(False))
    longer = F.coalesce(F.length(o), F.lit(0)) <= F.length(n)
    named = F.when(was_placeholder & ~F.lower(n).startswith(F.lower(nm)), F.concat(nm, F.lit(". "), n)).otherwise(n)
    return F.when((F.length(n) >= min_len) & (longer | was_placeholder), named).otherwise(o)


def release(df: DataFrame, col: str, now, minutes: int) -> DataFrame:
    keep = F.when(filters.is_stale(col, now, minutes), F.lit(None)).otherwise(F.col(col))
    return df.withColumn(col, keep)
