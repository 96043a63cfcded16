"""SparkSession construction and cluster-level settings.

On a cluster the session already exists and carries its own configuration;
``get_session`` only fills settings that are unset, so a deployment's
``spark.checkpoint.dir`` / shuffle sizing always wins.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on for correct results (UTC wall clock) or for
# runtime re-planning (AQE: coalescing, skew-join splitting, runtime
# broadcast conversion behind a measured size check).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # coalesce small shuffle partitions to the advisory size rather than to the
    # default parallelism (Spark's advice for busy clusters: fewer tiny tasks)
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}

TARGET_PARTITION_BYTES = 256 * 1024 * 1024
ROWS_PER_TASK = 1 << 19      # where shuffled sizes mislead (tasks_for): some 100 MB at 200 bytes a row


def scale_conf(input_bytes: int, total_cores: int) -> dict[str, str]:
    """Sizing for a large run (e.g. 100 TB on ~1000 executors).

    Initial shuffle partitions ~ input / 256 MB (at least 2x the cores), so a
    post-scan shuffle partition fits comfortably in executor memory; AQE then
    coalesces what the aggregates shrank and splits skewed partitions. Scan
    splits of 256 MB keep file-open overhead low on large columnar files.
    """
    parts = max(2 * total_cores, -(-int(input_bytes) // TARGET_PARTITION_BYTES))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
        "spark.sql.files.maxPartitionBytes": str(TARGET_PARTITION_BYTES),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(TARGET_PARTITION_BYTES),
    }


def configure_for_scale(spark: SparkSession, input_bytes: int, total_cores: int) -> SparkSession:
    for k, v in scale_conf(input_bytes, total_cores).items():
        spark.conf.set(k, v)
    return spark


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "civicflow") -> SparkSession:
    """Return the active session, or build a local one for tests/bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        configure(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.driver.memory", os.environ.get("CIVICFLOW_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Set the session clock, on which results depend, and those other settings that the caller left unset."""
    for k, v in REQUIRED_CONF.items():
        if k == "spark.sql.session.timeZone" or spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and stream state.

    Read from ``spark.checkpoint.dir`` (the cluster names a shared, reliable
    file system there). Only when it is unset -- local tests and the bench --
    a scratch folder is created and recorded in the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder (e.g. on the cluster's "
                               "distributed file system) for checkpoints and stream state")
        path = tempfile.mkdtemp(prefix="civicflow-ckpt-")      # single-machine runs only (tests, bench)
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df):
    """Cut lineage before a multi-pass operator: write ``df`` once as a Parquet
    table under the shared ``spark.checkpoint.dir`` and read it back.

    Later passes re-read this small columnar projection (with column pruning)
    instead of recomputing upstream joins, and a lost executor never
    recomputes them. Unlike ``Dataset.checkpoint`` this computes the plan once
    and stores compressed columns rather than serialised rows.

    The job runs here, not when the caller's query does. The table belongs to
    the session until ``release`` removes it."""
    base = checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/materialized/{uuid.uuid4().hex}"
    _OWNED.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(df) -> int:
    """How many tasks hold ``df`` at about ``ROWS_PER_TASK`` rows each, for a ``repartition`` by keys of rows that
    are much alike: those shrink in a shuffle, so that tasks dealt by shuffled bytes would hold too many of them.
    The rows are counted, so ``df`` should be a table or a plain selection of one."""
    return max(2, -(-df.count() // ROWS_PER_TASK))


class Scratch:
    """Written tables of one job, removed when the job is over (``with Scratch(spark) as scratch``)
    or, one at a time, when the job no longer reads them. For results that are used up or
    stored elsewhere inside the block; a DataFrame that leaves it must not be built on them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df):
        out = materialize(df)
        self.paths[id(out)] = (out, _OWNED[-1])
        return out

    def drop(self, *tables) -> None:
        for table in tables:
            _, path = self.paths.pop(id(table))
            _remove(self.spark, path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc) -> None:
        self.drop(*[table for table, _ in self.paths.values()])


def _remove(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)
    if path in _OWNED:
        _OWNED.remove(path)


_OWNED: list[str] = []        # tables that ``materialize`` wrote and nobody has released


def release(spark: SparkSession) -> int:
    """Remove the tables that ``materialize`` has written in this process, for
    callers that are done with every result built on them. Returns how many."""
    paths = list(_OWNED)
    for path in paths:
        _remove(spark, path)
    return len(paths)
