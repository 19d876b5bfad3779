"""Session defaults and the few session-level helpers the operators share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "citeloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC timestamps and Arrow transfer on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_TEMPORARY: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below the cluster's shared ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder, which goes when the
    process ends. On a cluster the setting must name storage that all machines share.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        app = spark.sparkContext.applicationId
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if app not in _TEMPORARY:
            _TEMPORARY[app] = tempfile.mkdtemp(prefix="citeloom-")
            atexit.register(shutil.rmtree, _TEMPORARY[app], ignore_errors=True)
        shared = _TEMPORARY[app]
    return f"{shared.rstrip('/')}/run-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a loop's state as a table in the shared folder and read it back.

    The table survives the loss of any executor, is computed once, and gives the
    next round true sizes: a checkpointed plan keeps the estimates of the plan it
    replaced, which joins multiply round after round.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Bytes of a table that may be dealt out over the cores before text or vector work.
SMALL_TABLE_BYTES = 256 << 20


def spread(scan: DataFrame) -> DataFrame:
    """Deal out the rows of a table of at most SMALL_TABLE_BYTES that comes in fewer splits than cores.

    A file with one row group is one split, so a small table of long texts would keep one
    core busy. The bound is in bytes and the same for every cluster; larger tables are never shuffled.
    """
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SMALL_TABLE_BYTES:
        return scan
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` dealt out by ``key`` in parts of about ``rows`` rows.

    Rows are moved while they are short. What grows from them and is grouped by the key, also together with other
    columns, stays in its task, whose memory does not grow with the table.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
    return df.repartition(parts, key)
