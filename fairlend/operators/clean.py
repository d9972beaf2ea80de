"""Cleaning: projections, filters, casts, union, sampling.

Every function is ``DataFrame -> DataFrame`` and lazy; a full cleaning run
is one narrow Spark stage (scan → filter → project) with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fairlend.functions import codes
from fairlend.functions.columns import inside_open, key_hash_unit, nonneg_or_null, to_double


def drop_if_present(df: DataFrame, cols: Iterable[str] = codes.DROPPED_COLUMNS) -> DataFrame:
    """Drop columns that exist; names that are absent are ignored."""
    present = [c for c in cols if c in df.columns]
    return df.drop(*present) if present else df


def drop_null_keys(df: DataFrame, keys: Sequence[str] = codes.NULL_KEY_COLUMNS) -> DataFrame:
    """Drop rows where any key field is null.

    Runs before numeric coercion, so a key that is present but unparseable
    (``'Exempt'``) survives here and becomes null only afterwards.
    """
    cond = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(cond)


def coerce_numeric(df: DataFrame, cols: Iterable[str] = codes.NUMERIC_COLUMNS) -> DataFrame:
    """Text → double for each listed column that exists; junk → null."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: to_double(c) for c in present}) if present else df


def keep_nonneg_or_null(df: DataFrame, cols: Iterable[str] = codes.NONNEG_COLUMNS) -> DataFrame:
    """Keep rows whose measures are ``>= 0`` or missing."""
    present = [c for c in cols if c in df.columns]
    if not present:
        return df
    return df.where(reduce(lambda a, b: a & b, [nonneg_or_null(c) for c in present]))


def union_years(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by column name; a column missing in one year is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def restrict_states(df: DataFrame, states: Sequence[str] = codes.STATES,
                    col: str = "state_code") -> DataFrame:
    """Keep the studied states."""
    return df.where(F.col(col).isin(list(states)))


def derive_approved(df: DataFrame, approve: Sequence[int] = codes.APPROVED_ACTIONS,
                    deny: Sequence[int] = codes.DENIED_ACTIONS,
                    action_col: str = "action_taken", out: str = "approved") -> DataFrame:
    """Keep decided applications and derive the 0/1 approval label."""
    a = F.col(action_col)
    label = F.when(a.isin(list(approve)), F.lit(1)).when(a.isin(list(deny)), F.lit(0))
    return df.where(a.isin(list(approve) + list(deny))).withColumn(out, label.cast("int"))


def clean_applications(raw: DataFrame, states: Sequence[str] = codes.STATES) -> DataFrame:
    """O19–O25 in the order of the studied preparation step.

    drop unused column → drop null keys → state and decision restriction
    with the approval label → numeric coercion → non-negative-or-null filters.
    """
    df = drop_if_present(raw)
    df = drop_null_keys(df)
    df = restrict_states(df, states)
    df = derive_approved(df)
    df = coerce_numeric(df)
    return keep_nonneg_or_null(df)


def _audit_steps(raw: DataFrame, states: Sequence[str]) -> list[tuple[str, Column]]:
    """Each rule's name and whether a row is left after it and all before it."""
    keys_ok = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in codes.NULL_KEY_COLUMNS])
    state_ok = F.col("state_code").isin(list(states))
    action_ok = F.col("action_taken").isin(codes.APPROVED_ACTIONS + codes.DENIED_ACTIONS)
    steps = [("raw", F.lit(True))]
    cond = keys_ok
    steps.append(("null_keys_dropped", cond))
    cond = cond & state_ok
    steps.append(("state_restricted", cond))
    cond = cond & action_ok
    steps.append(("decision_restricted", cond))
    for c in codes.NONNEG_COLUMNS:
        if c in raw.columns:
            cond = cond & nonneg_or_null(to_double(c))
            steps.append((f"{c}_nonneg", cond))
    return steps


def audit_cleaning(raw: DataFrame, states: Sequence[str] = codes.STATES) -> DataFrame:
    """Rows left after each cleaning rule, from ONE aggregation pass.

    Instead of a ``count()`` job per step, each step is a cumulative
    predicate and all are counted together (partial + final aggregate).
    Returns long form ``(step_no, step, rows)``.
    """
    steps = _audit_steps(raw, states)
    counts = raw.agg(*[F.count_if(c).alias(f"s{i}") for i, (_, c) in enumerate(steps)])
    stacked = ", ".join(f"{i}, '{name}', s{i}" for i, (name, _) in enumerate(steps))
    return counts.selectExpr(f"stack({len(steps)}, {stacked}) as (step_no, step, rows)")


class CleaningAudit:
    """O14 as a side result: the counts of :func:`audit_cleaning`, taken while something else reads the rows.

    ``observed`` is ``raw`` with the counters attached; the first action on what
    is derived from it fills them, in the tasks that read the rows anyway.
    Spark adds up every finished task, so a stage that runs again after a lost
    executor can count rows twice: :meth:`table` takes how many rows came out of
    the action and counts again, in a pass of its own, where the two differ.
    ``raw`` should come from ``plans.session.side_session``.
    """

    def __init__(self, raw: DataFrame, states: Sequence[str] = codes.STATES):
        self.raw, self.states, self.steps = raw, states, _audit_steps(raw, states)
        self._counts = Observation()
        self.observed = raw.observe(self._counts, *[F.count_if(c).alias(f"s{i}") for i, (_, c) in enumerate(self.steps)])

    def table(self, kept: int) -> DataFrame:
        """(step_no, step, rows) after an action whose result holds ``kept`` rows; waits for that action."""
        found = self._counts.get
        rows = [(i, name, int(found.get(f"s{i}") or 0)) for i, (name, _) in enumerate(self.steps)]
        if rows[-1][2] != kept:
            return audit_cleaning(self.raw, self.states)
        return self.raw.sparkSession.createDataFrame(rows, "step_no int, step string, rows long")


# --- per-study preparation (the three studies filter differently, D8) ------

def fill_defaults(df: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Per-column null fill (NaN is filled as well)."""
    return df.na.fill(defaults or codes.FILL_DEFAULTS)


def prep_approval(df: DataFrame) -> DataFrame:
    """Rows for the approval model.

    decided label, year and county present, defaults filled, non-negative
    income and amount after the fill.
    """
    df = df.where(F.col("approved").isin(0, 1))
    df = df.where(F.col("activity_year").isNotNull() & F.col("county_code").isNotNull())
    df = fill_defaults(df)
    return df.where((F.col("income") >= 0) & (F.col("loan_amount") >= 0))


def prep_gap(df: DataFrame) -> DataFrame:
    """O26–O27 for the county gap study: decided label and county present."""
    return df.where(F.col("approved").isin(0, 1) & F.col("county_code").isNotNull())


def prep_rate(df: DataFrame, bounds: tuple[float, float] = codes.RATE_BOUNDS) -> DataFrame:
    """Approved loans with a rate in the open interval, county present."""
    df = df.where((F.col("approved") == 1) & inside_open("interest_rate", *bounds) & F.col("county_code").isNotNull())
    return fill_defaults(df)


def sample_by_key(df: DataFrame, fraction: float, keys: Sequence[str]) -> DataFrame:
    """O31 (primary form): keep rows whose key hash falls below ``fraction``.

    Independent of partitioning and task order, so re-runs, retries after
    executor loss, and different cluster sizes all draw the same rows.
    """
    return df.where(key_hash_unit(keys) < F.lit(float(fraction)))


def sample_bernoulli(df: DataFrame, fraction: float, seed: int = codes.SAMPLE_SEED) -> DataFrame:
    """O31 (as in the study): seeded Bernoulli sample without replacement."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)
