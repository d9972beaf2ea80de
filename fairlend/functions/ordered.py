"""Exact order statistics without funnelling data into one task.

Spark's exact ``percentile`` merges one value→count map per group in a
single task, and a window with ``orderBy`` but no ``partitionBy`` moves every
row into one partition.  Both break at cluster scale.  The helpers here
compute exact prefix sums in three distributed steps, the same at every size:

1. collapse the input to one row per distinct order value (partial
   aggregation first, so a value held by a third of all rows costs one row);
2. deal those rows to ranges with Spark's own range partitioning, which
   samples the bounds; the partition number is the range's number.  There are
   as many ranges as shuffle partitions (``size_shuffles`` sets those from the
   input's size), ``MIN_RANGES`` at least;
3. inside each range, a running sum over a window partitioned by range, plus
   the range's offset from a window over the range totals.  For quantiles only
   the ranges that hold the wanted ranks are windowed.

The sampled bounds only decide *where* a value is computed; every count is
exact.  Values are ordered as Spark orders doubles: -inf first, then finite
values, +inf, and NaN last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlend.functions.lineage import materialize

_RANGE = "__range"
MIN_RANGES = 8


def range_count(df: DataFrame) -> int:
    """Ranges for a table: the session's shuffle width, ``MIN_RANGES`` at least; there is no maximum."""
    return max(MIN_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _ranged(df: DataFrame, keys: Sequence[str], buckets: int | None) -> DataFrame:
    """``df`` dealt to ranges of ``keys``, each row with its range's number."""
    return (df.repartitionByRange(buckets or range_count(df), *keys)
            .withColumn(_RANGE, F.spark_partition_id()))


def _offsets(ranged: DataFrame, by: list[str], weights: Sequence[str]) -> DataFrame:
    """Per group and range: each weight's total, what stands before the range, and the group's total.

    One row per group and range that holds rows of it.
    """
    totals = ranged.groupBy(*by, _RANGE).agg(*[F.sum(w).alias(f"{w}__in") for w in weights])
    before = Window.partitionBy(*by).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    return totals.select(
        *by, _RANGE, *[f"{w}__in" for w in weights],
        *[F.coalesce(F.sum(f"{w}__in").over(before), F.lit(0)).alias(f"{w}__off") for w in weights],
        *[F.sum(f"{w}__in").over(whole).alias(f"{w}__all") for w in weights])


def _join(rows: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """Join on the groups (nulls meet) and the range; Spark broadcasts ``table`` if its real size allows."""
    renamed = table.withColumnsRenamed({k: f"__r_{k}" for k in [*by, _RANGE]})
    on = F.col(_RANGE) == F.col(f"__r_{_RANGE}")
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return rows.join(renamed, on).drop(*[f"__r_{k}" for k in [*by, _RANGE]])


def prefix_sums(df: DataFrame, order_col: str, weight_cols: Sequence[str],
                by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Add ``<w>_before`` = sum of ``w`` over rows of the same ``by`` group
    with a smaller ``order_col``.

    ``df`` must have one row per distinct (``by``, ``order_col``), nulls
    excluded; ``weight_cols`` are non-negative counts or sums.  The dealt rows
    are checkpointed, since totals and running sums must see the same ranges.
    """
    by = list(by)
    ranged = materialize(_ranged(df, [*by, order_col], buckets))
    within = Window.partitionBy(*by, _RANGE).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    running = ranged.select("*", *[F.coalesce(F.sum(w).over(within), F.lit(0)).alias(f"{w}__run")
                                   for w in weight_cols])
    out = _join(running, _offsets(ranged, by, weight_cols), by)
    return out.select(*df.columns, *[(F.col(f"{w}__off") + F.col(f"{w}__run")).alias(f"{w}_before")
                                     for w in weight_cols])


def grouped_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                      by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles of ``value`` per ``by`` group.

    Same definition as SQL ``percentile_cont``: position ``h = (n-1)p`` in
    the sorted non-null values, ``v[floor h] + (h - floor h)(v[ceil h] - v[floor h])``,
    and ``v[floor h]`` itself where both neighbours are equal, so an infinite
    value stays what it is.  Nulls and NaN are ignored.  Output: ``by``
    columns, ``n``, ``q_0..q_k``.
    """
    return quantiles_from_counts(value_counts_table(df, value, by, buckets), probs, by)


def value_counts_table(df: DataFrame, value: str, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """``(by..., v, c, range)``: one row per distinct non-null value, dealt to ranges and checkpointed.

    The only pass over the input; partial aggregation first, so a value
    that fills a third of the rows costs one row per task before the
    shuffle.
    """
    by = list(by)
    x = F.col(value).cast("double")
    vals = df.select(*by, x.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    return materialize(_ranged(vals.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("c")), [*by, "v"], buckets))


def quantiles_from_counts(counts: DataFrame, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles from a table of :func:`value_counts_table`.

    Range totals show which ranges hold the ranks ``floor/ceil((n-1)p)``; the
    running-sum window runs inside those only (at most two per probability).
    """
    by = list(by)
    c, v = F.col("c"), F.col("v")

    def h(p):
        return (F.col("n") - 1).cast("double") * F.lit(float(p))

    def covers(lo_col, size_col, r):
        return (lo_col <= r) & (r < lo_col + size_col)

    offsets = _offsets(counts, by, ["c"]).withColumnsRenamed({"c__off": "off", "c__in": "tot", "c__all": "n"})
    wanted = None
    for p in probs:
        for r in (F.floor(h(p)), F.ceil(h(p))):
            cond = covers(F.col("off"), F.col("tot"), r)
            wanted = cond if wanted is None else (wanted | cond)
    rows = _join(counts, offsets.where(wanted).drop("tot"), by)
    within = Window.partitionBy(*by, _RANGE).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.select(*by, "v", "c", "n",
                         (F.col("off") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias("c_before"))
    aggs: list[Column] = []
    for i, p in enumerate(probs):
        for tag, r in (("lo", F.floor(h(p))), ("hi", F.ceil(h(p)))):
            aggs.append(F.min(F.when(covers(F.col("c_before"), c, r), v)).alias(f"{tag}_{i}"))
    picked = ranked.groupBy(*by, "n").agg(*aggs)
    out = []
    for i, p in enumerate(probs):
        lo_v, hi_v, part = F.col(f"lo_{i}"), F.col(f"hi_{i}"), h(p) - F.floor(h(p))
        out.append(F.when((lo_v == hi_v) | (part == 0), lo_v).otherwise(lo_v + part * (hi_v - lo_v)).alias(f"q_{i}"))
    return picked.select(*by, "n", *out)


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float],
                    buckets: int | None = None) -> DataFrame:
    """One row: ``n`` and ``q_<i>`` for ``probs[i]`` over the whole column."""
    return grouped_quantiles(df, column, probs, (), buckets)


def rank_sum_auc(df: DataFrame, label: str, score: str, buckets: int | None = None) -> DataFrame:
    """Area under the ROC curve by the rank-sum (Mann-Whitney) identity.

    Tied scores get averaged ranks, i.e. each positive scores 1 for every
    lower-scored negative and 1/2 for every equally scored one; NaN is one
    score above all others.  One row, column ``auc``; null if one class is
    absent.
    """
    per_score = (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
                 .groupBy(F.col(score).cast("double").alias("s"))
                 .agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
                      F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg")))
    return auc_from_score_counts(per_score, buckets)


def auc_from_score_counts(per_score: DataFrame, buckets: int | None = None,
                          extra: Sequence[str] = ()) -> DataFrame:
    """AUC from a ``(s, pos, neg)`` table with one row per distinct score, and the sums of ``extra``.

    One plan without a checkpoint: each range gives a row with its positives,
    its negatives and its inner pairs, and a window over those rows, one per
    range, adds the pairs between ranges.
    """
    ranged = _ranged(per_score, ["s"], buckets)
    within = Window.partitionBy(_RANGE).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("neg").over(within), F.lit(0))
    inner = ranged.withColumn("__pairs", F.col("pos").cast("double") * (before + F.col("neg") * 0.5))
    rows = inner.groupBy(_RANGE).agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "__pairs", *extra)])
    over = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    off = F.coalesce(F.sum("neg").over(over), F.lit(0))
    pairs = rows.withColumn("__pairs", F.col("__pairs") + F.col("pos").cast("double") * off)
    return pairs.agg(
        (F.sum("__pairs") / F.nullif(F.sum("pos").cast("double") * F.sum("neg").cast("double"), F.lit(0.0))).alias("auc"),
        *[F.sum(c).alias(c) for c in extra])
