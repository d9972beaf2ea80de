"""Group-gap analysis (O42–O49): aggregation, having, top-k, join, rank.

Scale notes
-----------
* ``group_gap`` is one hash aggregation on the group keys.  All five
  aggregates are algebraic, so Spark combines map-side before the shuffle:
  a county holding a third of all rows contributes one partial row per
  task, never a hot reducer.
* ``top_gaps`` is ``orderBy(...).limit(k)``: planned as
  ``TakeOrderedAndProject`` (per-task top-k, then a k-row merge), no full sort.
* ``county_map`` joins the county dimension to the gap table.  No broadcast
  hint is forced: the gap table has at most one row per (state, county) and
  AQE's runtime size check turns the join into a broadcast when it is small
  and keeps the shuffle join when it is not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlend.functions import codes
from fairlend.functions.columns import fips5, fips_label
from fairlend.functions.lineage import materialize
from fairlend.operators.clean import prep_gap
from fairlend.operators.features import add_comparison_group, add_race_group

GAP = "approval_disparity_gap"


def group_gap(df: DataFrame, keys: Sequence[str] = ("state_code", "county_code"),
              group_col: str = "comparison_group", a: str = codes.ADVANTAGED,
              b: str = codes.DISADVANTAGED, outcome: str = "approved",
              names: tuple[str, str] = ("advantaged", "disadvantaged")) -> DataFrame:
    """Per key, row count, per-side counts and per-side outcome means."""
    g = F.col(group_col)
    y = F.col(outcome)
    na, nb = names
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_applications"),
        F.sum(F.when(g == a, 1).otherwise(0)).cast("long").alias(f"{na}_n"),
        F.sum(F.when(g == b, 1).otherwise(0)).cast("long").alias(f"{nb}_n"),
        F.avg(F.when(g == a, y)).alias(f"{na}_approval_rate"),
        F.avg(F.when(g == b, y)).alias(f"{nb}_approval_rate"),
    )


def min_sample(df: DataFrame, n: int = codes.MIN_GROUP_N,
               cols: Sequence[str] = ("advantaged_n", "disadvantaged_n")) -> DataFrame:
    """HAVING both sides have at least ``n`` rows; ``n <= 0`` disables it."""
    if n <= 0:
        return df
    return df.where((F.col(cols[0]) >= n) & (F.col(cols[1]) >= n))


def add_gap(df: DataFrame, a: str = "advantaged_approval_rate",
            b: str = "disadvantaged_approval_rate", out: str = GAP) -> DataFrame:
    """Advantaged rate − disadvantaged rate (null when a side is empty)."""
    return df.withColumn(out, F.col(a) - F.col(b))


def gap_order(keys: Sequence[str] = ("state_code", "county_code"), gap: str = GAP):
    """Gap descending, nulls last, then the keys: a deterministic order."""
    return [F.desc_nulls_last(gap)] + [F.asc(k) for k in keys]


def county_gaps(apps: DataFrame, min_n: int = codes.MIN_GROUP_N) -> DataFrame:
    """The county gap table from cleaned applications."""
    df = add_comparison_group(add_race_group(prep_gap(apps)))
    stats = group_gap(df)
    return add_gap(min_sample(stats, min_n))


def top_gaps(gaps: DataFrame, k: int = codes.TOP_K,
             keys: Sequence[str] = ("state_code", "county_code")) -> DataFrame:
    """The ``k`` largest gaps (TakeOrderedAndProject)."""
    return gaps.orderBy(*gap_order(keys)).limit(k)


def add_fips(df: DataFrame, col: str = "county_code") -> DataFrame:
    """Zero-padded FIPS for joining, unpadded label for display."""
    return df.withColumns({"county_fips": fips5(col), "county_label": fips_label(col)})


def county_map(dimension: DataFrame, gaps: DataFrame) -> DataFrame:
    """Every county of the dimension, with its gap when one was estimated.

    Left equi join dimension ⟕ gaps on the five-character FIPS; ``has_gap``
    marks counties with an estimate.  Counties of other states and counties
    under the sample threshold stay, flagged false.
    """
    g = add_fips(gaps).select(
        "county_fips", "state_code", "total_applications", "advantaged_n",
        "disadvantaged_n", "advantaged_approval_rate", "disadvantaged_approval_rate", GAP)
    joined = dimension.join(g, "county_fips", "left")
    return joined.withColumn("has_gap", F.col(GAP).isNotNull())


def gap_range(mapped: DataFrame) -> DataFrame:
    """One row (gap_min, gap_max) over counties with an estimate."""
    return mapped.where("has_gap").agg(F.min(GAP).alias("gap_min"), F.max(GAP).alias("gap_max"))


def state_gap_map(mapped: DataFrame, states: Sequence[str] = codes.STATES) -> DataFrame:
    """Per-state map rows, selected by the dimension's state FIPS.

    Each row carries the shared colour range (min/max over flagged counties
    of all states) as scalar subqueries, so no cross join and no global
    window is needed, and ``estimated`` splits drawn from grey counties.
    The county table is checkpointed first, so the input is read once.
    """
    fips_to_state = {codes.STATE_FIPS[s]: s for s in states}
    # one row per county, read three times (rows, min, max): checkpoint it
    # once instead of recomputing the gap table from the input each time
    mapped = materialize(mapped)
    flagged = mapped.where("has_gap")
    vmin = flagged.agg(F.min(GAP)).scalar()
    vmax = flagged.agg(F.max(GAP)).scalar()
    state_label = None
    for fp, st in fips_to_state.items():
        cond = F.col("statefp") == fp
        state_label = F.when(cond, st) if state_label is None else state_label.when(cond, st)
    return (mapped.where(F.col("statefp").isin(list(fips_to_state)))
            .select(state_label.alias("map_state"), "county_fips", "name", GAP,
                    F.col("has_gap").alias("estimated"),
                    vmin.alias("gap_min"), vmax.alias("gap_max")))


def ranked_gap_table(mapped: DataFrame, k: int = codes.TOP_K, digits: int = 4) -> DataFrame:
    """Top ``k`` flagged counties, ranked 1..k, gap rounded.

    The ranking window runs over the ``k`` rows left after the limit only.
    """
    top = (mapped.where("has_gap")
           .orderBy(F.desc(GAP), F.asc("county_fips"))
           .limit(k))
    w = Window.orderBy(F.desc(GAP), F.asc("county_fips"))
    return top.select(
        F.row_number().over(w).alias("rank"),
        F.col("name").alias("county"),
        F.col("state_code").alias("state"),
        F.col("county_fips").alias("fips"),
        F.round(F.col(GAP), digits).alias("approval_gap"),
    )
