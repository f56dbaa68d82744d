"""Session builder and the shared scratch folder used by file round trips."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Scratch folders of local sessions, by application.
_LOCAL_DIRS: dict[str, str] = {}


def build_session(app: str = "barloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators assume: UTC clock, adaptive plans."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of its own for streams with keyed state, which is kept in RocksDB.

    The settings of the given session, but for its number of shuffle
    partitions, are neither taken nor touched.
    """
    own = spark.newSession()
    own.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    own.conf.set("spark.sql.session.timeZone", "UTC")
    partitions = "spark.sql.shuffle.partitions"
    own.conf.set(partitions, spark.conf.get(partitions))
    return own


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The session names it in ``spark.checkpoint.dir``. Where that is unset, one
    machine (a local master, as in tests) uses a temporary folder of its own;
    a cluster is refused, since its executors would each write to their own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master.split("[")[0] != "local":
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on master {master!r}")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_DIRS:
        _LOCAL_DIRS[application] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_DIRS[application]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a reused intermediate table to the shared folder and read it back.

    Cuts the lineage on storage that survives lost executors, so that later
    steps neither recompute it nor scan the bars again.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
