"""Session defaults and the shared folder that long lineages are cut into."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: set[str] = set()
BATCH_BYTES = 2 << 20


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "webloom") -> SparkSession:
    """A session for tests and the bench; on a cluster the submitter's settings stand."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("WEBLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: spark.checkpoint.dir, or our own where it is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="webloom-")
    _OWN.add(own)
    sc.setCheckpointDir("file://" + own)
    return "file://" + own


def new_table_path(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/webloom-{tag}-{uuid.uuid4().hex[:12]}"
    if path.startswith("file:"):
        _OWN.add(path.removeprefix("file://"))
    return path


def materialize(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = new_table_path(spark, tag)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Rows go to Python in Arrow batches of about BATCH_BYTES, a row at least. By rows alone a batch of texts is tens of MB,
    of which each task holds copies outside the heap and in its worker. A size that is set already stands."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


@atexit.register
def _sweep() -> None:
    for path in _OWN:
        shutil.rmtree(path, ignore_errors=True)
