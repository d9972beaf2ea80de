"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from fairlend.plans.session import shared_dir
from fairlend.sources.store import delete

#: Paths written inside each open ``scratch``, the innermost last.
_OPEN: list[list[str]] = []


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts the lineage, survives lost executors, and gives later joins the
    table's real size, from which Spark decides on a broadcast.  ``keep``: the
    table outlives the innermost :func:`scratch` (not the one around it).
    """
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    owners = _OPEN[:-1] if keep else _OPEN
    if owners:
        owners[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that ``stored`` writes inside, at the end; what is needed after it is stored with ``keep``."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            delete(spark, path)
