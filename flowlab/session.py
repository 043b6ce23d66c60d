"""Session helpers: building a local session, checkpoint folder, size-checked broadcast."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Default row bound under which a derived side table is broadcast. The bound is
# checked with a count on the (already aggregated) table before the hint is added.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 << 20


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "flowlab") -> SparkSession:
    """Local session for tests and the bench; on a cluster use the existing session."""
    master = master or os.environ.get("FLOWLAB_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("FLOWLAB_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("FLOWLAB_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is configured by the deployment (a shared file
    system path). A local session (one JVM, as in tests) gets a folder of its
    own when the setting is absent; any other master without the setting is an
    error, because executors could not see a driver-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="flowlab-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _row_bytes(df: DataFrame):
    """About the bytes of a row: 8 a column, and what strings, binaries, arrays, maps and structs hold."""
    total = F.lit(8 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        kind, col = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(col), F.lit(0))
        elif kind in ("array", "map", "struct"):
            total = total + F.coalesce(F.octet_length(col.cast("string")), F.lit(0))
    return total


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``df`` only if a pass over it proves at most ``max_rows`` rows and about ``max_bytes`` bytes.

    Meant for aggregated side tables (cut points, per-group counts, parameter
    rows). The table is checkpointed first, so its aggregation runs once for
    both the size check and the join. Above the bounds the (checkpointed)
    DataFrame is returned without the hint and Spark plans a shuffle join.
    """
    small = cut_lineage(df)  # computed once; the size check and the join read the stored copy
    size = small.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(_row_bytes(small)), F.lit(0)).alias("b")).first()
    return F.broadcast(small) if size["n"] <= max_rows and size["b"] <= max_bytes else small


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder of its own under the shared checkpoint folder (not created yet)."""
    import uuid

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> bool:
    """Deletes a folder that :func:`scratch_folder` named, wherever the shared file system is; False if there is none.

    Only folders below the checkpoint folder are taken. Needs a classic session
    (the file system is reached through the JVM of the driver).
    """
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if not path.startswith(base + "/") or ".." in path:
        raise ValueError(f"{path} is not below {base}")
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))
