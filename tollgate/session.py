"""Session helpers: one place that builds a SparkSession for tests/bench and
resolves the shared checkpoint folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.ansi.enabled": "true",
}


def shuffle_partitions_for(shuffled_bytes: int, target_bytes: int = 1024 ** 3, least: int = 1,
                           most: int = 50_000) -> int:
    """Shuffle partitions of about ``target_bytes`` each, from what the job
    shuffles.  Map tasks times partitions is the number of shuffle blocks, so
    there is a bound; beyond it partitions get larger and spill."""
    return max(least, min(most, -(-shuffled_bytes // target_bytes)))


#: partitions of a stateful stream: they stay for the life of its checkpoint
STREAM_PARTITIONS = 1000

# Settings for a large cluster, whatever the job.  Broadcasts are decided only
# on measured sizes: the estimate-based threshold is off, and AQE turns a join
# into a broadcast join only after the build side has materialised at <= 64 MB.
# (Local sessions keep Spark's default 10 MB estimate check, which suits the
# small test tables.)  Arrow batches bound the Python fold's memory per
# batch; RocksDB keeps streaming state off the JVM heap.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def cluster_conf(shuffled_bytes: int = 0, streaming: bool = False) -> dict[str, str]:
    """CLUSTER_CONF with the shuffle partitions of one job."""
    n = STREAM_PARTITIONS if streaming else shuffle_partitions_for(shuffled_bytes, least=200)
    return {**CLUSTER_CONF, "spark.sql.shuffle.partitions": str(n)}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app: str = "tollgate", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the benchmark (cluster jobs receive theirs)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every query relies on: the time zone, and arithmetic that fails
    rather than wraps."""
    for key, value in (("spark.sql.session.timeZone", "UTC"), ("spark.sql.ansi.enabled", "true")):
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``.  Only a local-mode session without one (tests)
    gets a scratch folder under /tmp; a cluster session without one fails."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor shares")
        d = tempfile.mkdtemp(prefix="tollgate-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives the loss
    of an executor, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
