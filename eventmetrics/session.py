"""Session settings and the shared folder for state that outlives a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Config tables (rules, keys, sources) are joined without hints: Catalyst
    # broadcasts them while they are below this size and shuffles beyond it.
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # State that is kept or timed by the clock asks for another batch after every one, without end
    # where a query is to stop when all input is read. Batches come with input only.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.ui.enabled": "false",
    # Recording the Python line of every column call costs several round trips each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


# Where a cluster's sessions start grouped shuffles: adaptive execution merges
# small partitions but never splits one that an aggregation needs together.
CLUSTER_SETTINGS = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8192"}


def build_session(app: str = "eventmetrics", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = SETTINGS if master and master.startswith("local") else SETTINGS | CLUSTER_SETTINGS
    for key, value in settings.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def stream_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session for stateful streams: RocksDB state, ``state_partitions`` parts of it.

    Their number is fixed by the first run of a checkpoint, whatever the
    cluster grows to later, so give it on a cluster with changing size; it is
    one per core of the moment otherwise.
    """
    session = spark.newSession()
    for key in (
        "spark.sql.session.timeZone",
        "spark.sql.streaming.stateStore.providerClass",
        "spark.sql.streaming.noDataMicroBatches.enabled",
    ):
        session.conf.set(key, SETTINGS[key])
    session.conf.set("spark.sql.shuffle.partitions", str(state_partitions or spark.sparkContext.defaultParallelism))
    return session


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, the one all executors share.

    Where the setting is missing, only a local session may fall back to a
    temporary folder: on a cluster that folder would exist on one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="eventmetrics-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
