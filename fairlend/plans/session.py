"""Session construction and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from fairlend.functions.lineage import parallelism


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "fairlend", extra: dict | None = None) -> SparkSession:
    """A session with AQE on and the web UI off.

    On a cluster, leave ``master`` unset and size ``shuffle_partitions`` to
    the data (≈ input bytes / 128 MB); AQE then coalesces small partitions
    and splits skewed ones at run time.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # remove checkpoint files of reduced tables once they are unreachable
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def side_session(spark: SparkSession) -> SparkSession:
    """Another session of the same application, under the SQL settings of ``spark``.

    Once a session has taken observed metrics, Spark 4.1 fails to ship the
    scoring functions of ML models that belong to it (they reach the session's
    observation manager, which cannot be serialised).  Observed reads get a
    session of their own.
    """
    side = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            side.conf.set(key, value)
    return side


TARGET_PARTITION_BYTES = 128 * 1024 * 1024


def size_shuffles(spark: SparkSession, input_bytes: int,
                  target_bytes: int = TARGET_PARTITION_BYTES) -> int:
    """Set the shuffle width from the input size and return it.

    About one shuffle partition per ``target_bytes`` of input (128 MB: a
    partition that fits an executor core's memory share without spilling),
    never fewer than the cluster's cores.  AQE then coalesces partitions that
    turn out small (aggregated outputs) toward the same advisory size and
    splits skewed ones.  100 TB of input gives ~800k partitions for a shuffle
    of the full rows; aggregations shuffle far less and are coalesced.
    """
    parts = max(parallelism(spark), -(-int(input_bytes) // int(target_bytes)))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_bytes))
    return parts


def input_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Total size of the files under ``paths``, from the file system's own summary."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        total += path.getFileSystem(conf).getContentSummary(path).getLength()
    return total


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The context's checkpoint folder, registering one only if none is set.

    Reads ``spark.checkpoint.dir`` from the session first.  Where the cluster
    names none, a private temporary folder serves a local master only; on any
    other master driver and executors see different disks, so this raises.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server owns the checkpoint folder
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    base = sc.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not is_local(sc.master):
                raise ValueError("set spark.checkpoint.dir (jobs: --checkpoint-dir) to a folder that the driver "
                                 f"and all executors of {sc.master} share")
            base = tempfile.mkdtemp(prefix="fairlend-ckpt-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir() or base
    return base


def is_local(master: str) -> bool:
    """Whether driver and executors are one process (``local``, ``local[4]``; not ``local-cluster``)."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the cluster's shared checkpoint location."""
    base = ensure_checkpoint_dir(spark)
    sep = "" if base.endswith("/") else "/"
    return f"{base}{sep}fairlend-{name}-{uuid.uuid4().hex[:12]}"
