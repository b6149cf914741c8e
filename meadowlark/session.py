"""Session defaults and reliable lineage cuts."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "meadowlark", **conf) -> SparkSession:
    """A session with adaptive execution, runtime skew handling and UTC clocks."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # page bodies are large: few rows per Arrow batch keep Python workers small
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a temporary one is made only on a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="meadowlark-")
    sc.setCheckpointDir(configured)
    return configured


def durable(df: DataFrame) -> DataFrame:
    """Materialize in the checkpoint folder, so that later reads see the same rows
    in the same partitions even after executors are lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Written to the checkpoint folder as a table and read back: computed once, while a checkpoint
    computes its last stage twice."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, rows: int) -> None:
    """Rows cross to Python in batches of at most ``rows`` in this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
