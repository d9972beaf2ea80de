"""Sinks (O7–O13).  Executors write; nothing large passes through the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlend.sources import store


def _flatten_vectors(df: DataFrame) -> DataFrame:
    """ML vectors are not a CSV type: turn them into double arrays, then text."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, VectorUDT):
            cols.append(F.to_json(vector_to_array(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", header: bool = True,
              sep: str = ",") -> None:
    """Distributed CSV write, one part file per task."""
    (_flatten_vectors(df).write.mode(mode).option("header", header).option("sep", sep).option("escape", '"')
     .csv(path))


def write_lossless_csv(df: DataFrame, path: str, mode: str = "overwrite", sep: str = ",") -> None:
    """Distributed CSV from which ``readers.read_lossless_csv`` gives back the very rows.

    Line breaks and backslashes inside values are escaped, so that a line is a
    row and files can be split; null is ``\\N``, empty text ``\\E``, and blanks
    around a value stay.  Numbers, dates and booleans are written as text that
    parses back to the same value.
    """
    flat = _flatten_vectors(df)
    rows = flat.select(*[escaped(F.col(f"`{c}`").cast("string")).alias(_escaped_name(c)) for c in flat.columns])
    (rows.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


# --- fixed values: the escapes of the lossless dialect; every backslash in a file begins one
NULL_MARK, EMPTY_MARK = "\\N", "\\E"
ESCAPES = [("\\", "\\b"), ("\n", "\\n"), ("\r", "\\r")]


def escaped(text: Column) -> Column:
    out = text
    for raw, mark in ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit(mark))
    return F.when(text.isNull(), F.lit(NULL_MARK)).when(text == "", F.lit(EMPTY_MARK)).otherwise(out)


def unescaped(text: Column) -> Column:
    """Undoes :func:`escaped`: the backslashes themselves last."""
    out = text
    for raw, mark in reversed(ESCAPES):
        out = F.replace(out, F.lit(mark), F.lit(raw))
    return F.when(text == EMPTY_MARK, F.lit("")).when(text != NULL_MARK, out)


def _escaped_name(name: str) -> str:
    for raw, mark in ESCAPES:
        name = name.replace(raw, mark)
    return name


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                  mode: str = "overwrite") -> None:
    """Parquet dataset, optionally partitioned (e.g. state, year)."""
    if partition_by:
        rebalanced(df, partition_by).write.mode(mode).partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def replace_years(df: DataFrame, path: str, years: Sequence[int],
                  partition_by: Sequence[str] = ("state_code", "activity_year"),
                  year_col: str = "activity_year", fmt: str = "parquet") -> None:
    """The rows of ``years`` in place of what the dataset holds of them; other years' files stay untouched.

    Dynamic partition overwrite: the job's commit puts each partition it wrote
    in place of the old one.  A partition of these years that got no rows this
    time (a state that the correction removed) is known by its files being still
    there after the commit, and removed.  A row of another year, or without one,
    fails the write before anything is replaced.  ``fmt``: parquet, or csv with header.
    """
    spark = df.sparkSession
    wanted = F.col(year_col).isin([int(y) for y in years])
    other = F.raise_error(F.concat(F.lit(f"a row of {year_col} "), F.coalesce(F.col(year_col).cast("string"), F.lit("null")),
                                   F.lit(f" is not among those to replace: {sorted(years)}")))
    checked = df.withColumn(year_col, F.when(wanted, F.col(year_col)).otherwise(other.cast(df.schema[year_col].dataType)))
    steps = [f"{c}={{{','.join(str(int(y)) for y in years)}}}" if c == year_col else "*" for c in partition_by]
    pattern = "/".join([path.rstrip("/"), *steps, "*"])
    old = store.matching(spark, pattern)
    write = rebalanced(checked, partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        write = write.option("header", True).option("escape", '"')
    write.partitionBy(*partition_by).format(fmt).save(path)
    left = set(old) & set(store.matching(spark, pattern))
    for folder in sorted({f.rsplit("/", 1)[0] for f in left}):
        store.delete(spark, folder)


def rebalanced(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Rows of a partition value together, so that it gets a few files and not one per task.

    AQE splits the large ones by the advisory size: a value with a third of
    the rows is written by many tasks.
    """
    return df.hint("rebalance", *partition_by)


def write_partitioned_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ("activity_year",),
                          mode: str = "overwrite") -> None:
    """One CSV folder per year (``activity_year=<y>/``)."""
    (rebalanced(df, partition_by).write.mode(mode).option("header", True).option("escape", '"')
     .partitionBy(*partition_by).csv(path))


def write_single_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One CSV part file.

    One task writes all rows, which suits results whose size a model's width
    or a top-k bounds (coefficients, top 25); ``write_csv`` is the sink for
    rows that grow with the input.
    """
    write_csv(df.coalesce(1), path, mode)


def show(df: DataFrame, n: int = 25) -> None:
    """Console table, untruncated."""
    df.show(n, truncate=False)
