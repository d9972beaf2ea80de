"""Materialising intermediate results that several branches of a plan read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df``; later branches read it instead of
    recomputing the input.

    Written to the shared folder the cluster names in ``spark.checkpoint.dir``
    (a private temporary folder is registered only when none is set, as in
    local tests), so the result survives the loss of the executors that
    computed it.  Use on reduced tables (distinct values, per-group counts)
    that feed more than one job.
    """
    from fairlend.plans.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Like :func:`materialize`, and later joins know the table's real size, from
    which Spark decides on a broadcast when it plans them.
    """
    from fairlend.plans.session import shared_dir

    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    """Tasks that the cluster runs at once."""
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # Spark Connect
        return 1
