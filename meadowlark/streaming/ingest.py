"""Streams: submissions, new pages and rolling event counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from meadowlark import schemas
from meadowlark.functions import dates
from meadowlark.functions import text as T
from meadowlark.operators import filters as B
from meadowlark.scale import keys_of
from meadowlark.session import stored


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.SUBMISSIONS).json(path)


def _land(df: DataFrame, path: str, epoch: int) -> None:
    """One folder per micro-batch, overwritten when the batch is replayed."""
    df.write.mode("overwrite").parquet(f"{path}/batch={epoch}")


NAME_GROUPS = 8192  # names of one group share a state; fixed for the life of a checkpoint


def _group_of(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(NAME_GROUPS)).cast("int").alias("_group")


class _FirstOfName(StatefulProcessor):
    """Of the valid submissions of a name the first is accepted, once and for all; a name that is in
    the state is taken. Rows are (key, valid, order, payload), the key being the name; of one batch the least order comes
    first. The state is that of a group of names, as calls for the state cost more than names do; only one row
    of a name is held, however many come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getListState("taken", StructType([StructField("name", StringType())]))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        if names := [(name,) for name in initialState["taken"]]:
            self.taken.appendList(names)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        taken = {row[0] for row in self.taken.get()} if self.taken.exists() else set()
        best = {}
        for part in rows:
            out = []
            for name, valid, order, payload in zip(part["key"], part["valid"], part["order"], part["payload"]):
                held = best.get(name)
                if not valid or name in taken:
                    out.append((payload, False))
                elif held is None or (order, payload) < held:
                    out += [] if held is None else [(held[1], False)]
                    best[name] = order, payload
                else:
                    out.append((payload, False))
            if out:
                yield pd.DataFrame(out, columns=["payload", "fresh"])
        if best:
            self.taken.appendList([(name,) for name in best])
            yield pd.DataFrame([(payload, True) for _, payload in best.values()], columns=["payload", "fresh"])

    def close(self) -> None:
        pass


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest_submissions(stream: DataFrame, known: Callable[[], DataFrame], accepted_path: str, rejects_path: str,
                       checkpoint: str, now=None, once: bool = True) -> StreamingQuery:
    """Validate submissions, refuse names that exist, land the rest.

    Names that are taken are keyed state of the stream, in groups of names. ``known`` (organizations) seeds it before
    the first batch of a checkpoint; after that a batch reads nothing but itself. State is kept
    with the checkpoint, so a replayed batch decides the same way and overwrites its folders.
    """
    checked = B.validate(stream)
    kept = [c for c in checked.columns if c not in ("matched",)]
    payload = F.to_json(F.struct(*kept), {"ignoreNullFields": "false"})
    rows = checked.select(F.coalesce(F.lower(T.strip("name")), F.lit("")).alias("key"), F.col("reason").isNull().alias("valid"),
                          F.xxhash64("name", "description").alias("order"), payload.alias("payload"))
    rows = rows.select(_group_of("key"), "*")
    seed = keys_of(known(), F.lower("name"), "taken").select(_group_of("taken"), "taken").groupBy("_group")
    judged = rows.groupBy("_group").transformWithStateInPandas(
        _FirstOfName(), "payload string, fresh boolean", "Append", "None", initialState=seed)
    schema = StructType([f for f in checked.schema.fields if f.name in kept])

    def handle(batch: DataFrame, epoch: int) -> None:
        read = stored(batch.select("fresh", F.from_json("payload", schema).alias("r")).select("fresh", "r.*"))
        trimmed = {c: T.strip(c) for c in ("name", "description", "country", "website") if c in read.columns}
        stamp = F.current_timestamp().cast("timestamp_ntz") if now is None else dates.moment(now)
        landed = read.where("fresh").withColumns(trimmed).drop("fresh", "reason").withColumn(
            "source", F.lit("user_submitted")).withColumn("created_at", stamp)
        if "website" in landed.columns:
            landed = landed.withColumn("direct_website", F.col("website"))
        _land(landed, accepted_path, epoch)
        # what the rules refused keeps its texts; a good one whose name is taken is trimmed
        refused = read.where("NOT fresh AND reason IS NOT NULL").drop("fresh")
        taken = read.where("NOT fresh AND reason IS NULL").drop("fresh").withColumns(trimmed).withColumn("reason", F.lit("duplicate_name"))
        _land(refused.unionByName(taken), rejects_path, epoch)

    conf = stream.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKS)  # the query takes it when it starts
    try:
        writer = judged.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        conf.unset(_PROVIDER) if before is None else conf.set(_PROVIDER, before)


def read_new_pages(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.PAGES)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def extract_pages_stream(pages: DataFrame, extract: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
                         once: bool = True) -> StreamingQuery:
    """Child rows of newly arrived pages, each page once: ``extract`` is any page operator."""
    def handle(batch: DataFrame, epoch: int) -> None:
        _land(extract(batch), out, epoch)

    writer = pages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_counts(events: DataFrame, every: str = "1 day", delay: str = "1 day", col: str = "start_date") -> DataFrame:
    """Counts per window and type. On a stream the watermark closes a window once events are
    later than it by the delay; on a table it has no effect."""
    timed = events.withColumn("_ts", F.col(col).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_ts", delay)
    return timed.groupBy(F.window("_ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def land_event_counts(stream: DataFrame, out: str, checkpoint: str, every: str = "1 day", delay: str = "1 day",
                      col: str = "start_date", once: bool = True) -> StreamingQuery:
    """Counts of the windows that the watermark has closed, each written once; later rows are dropped."""
    writer = event_counts(stream, every, delay, col).writeStream.outputMode("append").format("parquet")
    writer = writer.option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
