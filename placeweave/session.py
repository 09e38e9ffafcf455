"""Session construction and shared-folder helpers.

On a cluster the session is built by the platform; :func:`get_spark` only
fills in settings that are still unset, so a cluster's own configuration
always wins.  :func:`checkpoint_dir` reads ``spark.checkpoint.dir`` from the
session and invents a local folder only for ``local[*]`` test sessions.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Defaults tuned for large inputs; each is applied only when unset.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # X1 ships whole HTML documents through Arrow; keep batches small so a
    # batch of large pages stays well inside the Python worker's memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    # Broadcast only sides Spark has measured as small (AQE uses runtime
    # sizes); 32 MB keeps per-executor copies cheap at 1000 executors.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # Streams keep one key per captured page: state on disk, not on the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_spark(app: str = "placeweave", master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session or build one.  A master is set only when the
    caller passes one: ``spark-submit --master`` and the platform's own
    setting always win, and plain Python falls back to Spark's ``local[*]``."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    for key, value in _DEFAULTS.items():
        if spark.conf.get(key, None) in (None, ""):
            spark.conf.set(key, value)
    # The time zone must be pinned for ISO stamps at the sinks.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if shuffle_partitions is not None:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return spark


def _is_local(spark: SparkSession) -> bool:
    """One process: ``local``, ``local[n]``, ``local[*]`` — not ``local-cluster``."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, written tables and stream state.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir).  A
    private temporary folder is created only for local test sessions; on a
    cluster a missing setting is an error, never a machine-local fallback.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="placeweave-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique sub-folder of the shared checkpoint folder."""
    import uuid

    return f"{checkpoint_dir(spark)}/placeweave/{name}-{uuid.uuid4().hex[:12]}"
