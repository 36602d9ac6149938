"""Session defaults and the shared folder used to cut lineage."""
from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows one task may hold for a single group before an operator switches to its
# range-partitioned form. Override with the session setting of the same name.
TASK_ROWS_KEY = "driftgauge.task.rows"
TASK_ROWS_DEFAULT = 1_000_000

# Largest side (bytes) the library broadcasts after having measured it.
BROADCAST_BYTES_KEY = "driftgauge.broadcast.bytes"
BROADCAST_BYTES_DEFAULT = 32 * 1024 * 1024


# Largest intermediate (bytes, from counted rows) that is written once rather than recomputed by each pass.
PIN_BYTES_KEY = "driftgauge.pin.bytes"
PIN_BYTES_DEFAULT = 4 * 1024 * 1024 * 1024


def local_session(cpus: str = "*", shuffle_partitions: int = 8, app: str = "driftgauge") -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def task_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(TASK_ROWS_KEY, str(TASK_ROWS_DEFAULT)))


def broadcast_bytes(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_BYTES_KEY, str(BROADCAST_BYTES_DEFAULT)))


def compute_tasks(spark: SparkSession) -> int:
    """Partitions for work that is bound by computing rather than by bytes.

    Adaptive execution coalesces by size, which would leave such work on few cores.
    """
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pinned_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Pin a table that several passes read, unless writing it would exceed the session's limit."""
    limit = int(df.sparkSession.conf.get(PIN_BYTES_KEY, str(PIN_BYTES_DEFAULT)))
    return cut_lineage(df) if rows * row_bytes <= limit else df


def bounded_broadcast(table: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast hint only when a proven bound on the size is below the session's limit."""
    return F.broadcast(table) if rows * row_bytes <= broadcast_bytes(table.sparkSession) else table


def measured_broadcast(table: DataFrame, row_bytes: int = 128) -> DataFrame:
    """Broadcast hint after counting the table; beyond the limit the join shuffles instead.

    Meant for lookup tables keyed by a coarse key (stratum, case), where a shuffle
    join would send all rows of a hot key to one task.
    """
    return bounded_broadcast(table, table.count(), row_bytes)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only where it is unset."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        named = context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from there; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path of :func:`scratch_path` that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)  # noqa: SLF001


def collected(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files and checkpoints of tables that nothing refers to any more, which it does after a garbage collection of the driver."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # noqa: SLF001
