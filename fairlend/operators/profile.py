"""Profiling (O14–O18): counts, nulls, distinct values, value counts, describe.

Each profile is one aggregation job over the whole input; several
statistics share a pass instead of one ``count()`` action each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlend.functions.radix import summarize

QUARTILES = (0.25, 0.5, 0.75)


def shape(df: DataFrame) -> DataFrame:
    """One row ``(rows, cols)``."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("cols", F.lit(len(df.columns)))


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(column, nulls)`` per column, NaN counted as missing, one pass."""
    cols = list(cols or df.columns)
    types = dict((f.name, f.dataType) for f in df.schema.fields)

    def missing(c: str):
        x = F.col(c)
        if isinstance(types[c], (T.DoubleType, T.FloatType)):
            return x.isNull() | F.isnan(x)
        return x.isNull()

    wide = df.agg(*[F.count_if(missing(c)).alias(f"n{i}") for i, c in enumerate(cols)])
    pairs = ", ".join(f"'{c}', n{i}" for i, c in enumerate(cols))
    return wide.selectExpr(f"stack({len(cols)}, {pairs}) as (column_name, nulls)")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of one column (null kept as a value)."""
    return df.select(col).distinct()


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Non-null value → count, most frequent first (ties by value)."""
    return (df.where(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc(col)))


def frequent_values(df: DataFrame, cols: Sequence[str], share: float) -> dict[str, list]:
    """Per column, non-null values among which are all that more than ``share`` of the rows hold.

    Spark's ``freqItems`` keeps a Misra-Gries summary per column, at most
    ``2 / share`` counters each, in one pass over all columns: a frequent value
    is never missing, others may be there.
    """
    found = df.stat.freqItems(list(cols), share / 2).first()
    # the summary names column x "x_freqItems" and keeps the columns' order
    return {c: [v for v in items if v is not None] for c, items in zip(cols, found)}


def column_profile(df: DataFrame, cols: Sequence[str] | None = None, share: float = 0.01) -> DataFrame:
    """``(column_name, rows, nulls, value, n)``, the exact counts of all columns' frequent values in two passes.

    A row per column and value that more than ``share`` of the rows hold, the
    value as text; a column without such a value has one row with a null
    ``value`` and ``n``.  The first pass finds candidates
    (:func:`frequent_values`), the second counts them exactly, all columns in
    one aggregation with a counter per candidate, null and column: no column's
    distinct values are listed or shuffled.  NaN is a value; an empty table
    gives a row per column with 0 rows.
    """
    cols = list(cols or df.columns)
    spark = df.sparkSession
    wanted = frequent_values(df, cols, share)
    hits = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`")
        found = x.isin(wanted[c]) | x.isNull() if wanted[c] else x.isNull()
        hits.append(F.when(found, F.struct(F.lit(i).alias("i"), x.cast("string").alias("value"))))
    every = F.struct(F.lit(-1).alias("i"), F.lit(None).cast("string").alias("value"))
    hit = F.explode(F.array_compact(F.array(every, *hits))).alias("hit")
    counts = df.select(hit).groupBy("hit.i", "hit.value").agg(F.count("*").alias("n"))
    # as many rows as there are candidates: the window is over the model of the table, not its rows
    whole, own = Window.partitionBy(F.lit(0)), Window.partitionBy("i")
    counts = counts.withColumns({"rows": F.max(F.when(F.col("i") == -1, F.col("n"))).over(whole),
                                 "nulls": F.max(F.when(F.col("value").isNull(), F.col("n"))).over(own)})
    kept = counts.select(F.col("i").alias("k"), "rows", "nulls",
                         F.when(F.col("n") > share * F.col("rows"), F.col("value")).alias("value"),
                         F.when(F.col("value").isNotNull() & (F.col("n") > share * F.col("rows")), F.col("n")).alias("n"))
    rows = kept.groupBy("k").agg(
        F.max("rows").alias("rows"), F.max("nulls").alias("nulls"),
        F.array_compact(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("value", "n")))).alias("held"))
    # a column's entry may be missing where it has neither nulls nor candidates
    total = rows.where("k = -1").agg(F.coalesce(F.max("rows"), F.lit(0)).alias("rows"))
    names = spark.createDataFrame(list(enumerate(cols)), "i int, column_name string")
    out = names.join(rows.select("k", "nulls", "held"), F.col("i") == F.col("k"), "left")
    return out.select("column_name", total.select("rows").scalar().alias("rows"),
                      F.coalesce("nulls", F.lit(0)).cast("long").alias("nulls"),
                      F.explode_outer("held").alias("one")).select("column_name", "rows", "nulls", "one.value", "one.n")


def describe_column(df: DataFrame, col: str, digits: int | None = None) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles, max of one column.

    Long form ``(statistic, value)``, labelled as a dataframe ``describe``
    labels them.  Quartiles are exact and distributed (``functions.radix``),
    never a single-task percentile buffer.
    """
    return summary_long(df, [col], digits, std_label="std").drop("measure")


def _round(c, digits):
    return F.round(c, digits) if digits is not None else c


def summary_long(df: DataFrame, measures: Sequence[str], digits: int | None = None,
                 std_label: str = "stddev") -> DataFrame:
    """``summary()``-like table in long form ``(measure, statistic, value)``.

    Counts, moments and extremes come from the first pass of the radix
    selection (``functions.radix``) that finds the exact quartiles in at most
    four.  ``df`` is read once per pass, at once; keep the measures' columns
    around the call where reading them is dear.  A measure without values has
    a count of 0 and nulls.
    """
    names = ["count", "mean", std_label, "min", "25%", "50%", "75%", "max"]
    rows = [(m, label, None if value is None else float(value))
            for m, s in zip(measures, summarize(df, measures, QUARTILES))
            for label, value in zip(names, (s.n, s.mean, s.stddev, s.least, *s.quantiles, s.greatest))]
    out = df.sparkSession.createDataFrame(rows, "measure string, statistic string, value double")
    return out.withColumn("value", _round(F.col("value"), digits))
