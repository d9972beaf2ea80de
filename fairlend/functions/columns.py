"""Column-expression builders.

Everything here returns a ``Column`` built from built-in Spark SQL
functions, so it stays inside whole-stage codegen; no Python UDFs.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c: str | Column) -> Column:
    """Numeric coercion: unparseable text becomes null, NaN becomes null.

    ``try_cast`` keeps ANSI mode from throwing on values like ``'Exempt'``;
    NaN is folded into null so later ``>= 0`` and ``isNotNull`` tests see
    missing values the way a dataframe library's ``isna`` does.
    """
    # ``nanvl`` mentions the parsed value once: Catalyst inlines expressions
    # into every predicate that uses them, so a when(isnan(x), ..).otherwise(x)
    # form would parse each text value several times per row.
    return F.nanvl(col_of(c).try_cast("double"), F.lit(None).cast("double"))


def nonneg_or_null(c: str | Column) -> Column:
    """``c >= 0 OR c IS NULL``, written so ``c`` is evaluated once."""
    return F.coalesce(col_of(c) >= 0, F.lit(True))


def inside_open(c: str | Column, lo: float, hi: float) -> Column:
    """``lo < c < hi``, written so ``c`` is evaluated once; false for null and NaN.

    The value clamped to the bounds is one of them exactly if it is not inside.
    """
    clamped = F.least(F.greatest(col_of(c), F.lit(float(lo))), F.lit(float(hi)))
    return ~clamped.isin(float(lo), float(hi))


def guarded_ratio(num: str | Column, den: str | Column,
                  zero_as: float | None = 0.0) -> Column:
    """``num / den`` when both are positive, else ``zero_as`` (``None`` = null).

    The guard also keeps ANSI division from raising on a zero denominator.
    """
    n, d = col_of(num), col_of(den)
    fallback = F.lit(zero_as).cast("double")
    return F.when((n > 0) & (d > 0), n / d).otherwise(fallback)


def code_to_label(c: str | Column, mapping: Mapping[str, Sequence],
                  default: str | None) -> Column:
    """One CASE expression from ``{label: [codes]}``; unmatched → ``default``."""
    x = col_of(c)
    expr = None
    for label, codes in mapping.items():
        cond = x.isin(list(codes))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default).cast("string"))


def value_to_label(c: str | Column, mapping: Mapping, default: str | None = None) -> Column:
    """CASE over single values, e.g. loan type 1 → 'Conventional'."""
    return code_to_label(c, {v: [k] for k, v in mapping.items()}, default)


def fips5(c: str | Column) -> Column:
    """County code (double such as 6037.0) → zero-padded five-character FIPS."""
    return F.lpad(col_of(c).cast("int").cast("string"), 5, "0")


def fips_label(c: str | Column) -> Column:
    """County code → unpadded integer label ('6037')."""
    return col_of(c).cast("int").cast("string")


def key_hash_unit(keys: Iterable[str | Column]) -> Column:
    """Deterministic hash of the key columns in [0, 1).

    First 32 bits of md5 over the '|'-joined keys.  It depends only on the
    key values, not on partitioning or task order, so a sample drawn with it
    is identical on every run and every cluster size, and a plain SQL engine
    can reproduce it.
    """
    joined = F.concat_ws("|", *[col_of(k).cast("string") for k in keys])
    head = F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("bigint")
    return head.cast("double") / F.lit(float(2 ** 32))
