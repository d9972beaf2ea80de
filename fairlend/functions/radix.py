"""Exact order statistics of a few measures by radix selection.

Doubles map to 64-bit integers in the same order, and a quantile's rank is
followed down their 16-bit digits: the first pass counts every measure's values
by their leading digit, the next ones only the values under the leading digits
that hold a wanted rank.  A pass is one narrow aggregation: a task hands on at
most 65,536 counters for each measure and prefix, no row is exchanged and no
value is listed.  There are four passes at most, and fewer where a prefix's
values are all equal.

The input is read once per pass.  Callers whose input is dear to read (a join,
text) keep the measures' columns around the call; nothing else is kept or
written.  Passes end in rows whose number the measures and probabilities bound.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a digit, and digits of a key.
BITS = 16
DIGITS = 64 // BITS

# --- fixed values: the layout of a 64-bit floating-point number
_MANTISSA = 52
_BIAS = 1023
_SMALLEST_NORMAL = 2.0 ** -1022
_INFINITY_BITS = 0x7FF << _MANTISSA


def with_order_key(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with ``out``: a long that grows with the double ``value`` and is equal for equal values only.

    It is the number's own 64 bits, put together by arithmetic, with the sign
    of the number: -inf is the least, both zeros are 0, +inf the greatest.
    Null and NaN give null.
    """
    x, size, power = F.col(value), F.col("__size"), F.col("__power")
    two = F.lit(2.0)
    near = F.floor(F.log2(size)).cast("int")
    # log2 may miss the power by one next to a power of two
    exact = (near - (F.pow(two, near) > size).cast("int") + (F.pow(two, near + 1) <= size).cast("int"))
    tiny = size < _SMALLEST_NORMAL
    bits = (F.when(size == 0.0, F.lit(0).cast("long"))
            .when(size == float("inf"), F.lit(_INFINITY_BITS).cast("long"))
            .when(tiny, (size * 2.0 ** 537 * 2.0 ** 537).cast("long"))
            .otherwise(F.shiftleft((power + _BIAS).cast("long"), _MANTISSA)
                       + ((size / F.pow(two, power) - 1.0) * 2.0 ** _MANTISSA).cast("long")))
    staged = (df.withColumn("__size", F.when(~F.isnan(x), F.abs(x)))
              .withColumn("__power", F.when((size >= _SMALLEST_NORMAL) & (size < float("inf")), exact))
              .withColumn("__bits", bits))
    return staged.withColumn(out, F.when(x < 0, -F.col("__bits")).otherwise(F.col("__bits"))).drop(
        "__size", "__power", "__bits")


def _long(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """(measure number, v, key) of all values that are neither null nor NaN; -0.0 becomes 0.0."""
    pairs = ", ".join(f"{i}, CAST(`{m}` AS DOUBLE)" for i, m in enumerate(measures))
    rows = df.selectExpr(f"stack({len(measures)}, {pairs}) as (m, v)").where("v is not null and not isnan(v)")
    rows = rows.withColumn("v", F.when(F.col("v") == 0.0, F.lit(0.0)).otherwise(F.col("v")))
    return with_order_key(rows, "v", "key")


@dataclass
class Summary:
    """Of one measure: count, mean, sample standard deviation, least and greatest value, and quantiles."""
    n: int = 0
    mean: float | None = None
    stddev: float | None = None
    least: float | None = None
    greatest: float | None = None
    quantiles: list[float | None] = field(default_factory=list)


def _shift(level: int) -> int:
    """Bits below the digit of ``level``."""
    return BITS * (DIGITS - 1 - level)


def first_pass(long: DataFrame) -> DataFrame:
    """Counters by leading digit with the values before, and each measure's moments.

    The moments are put together from the digits' own: sums of squares around
    a digit's mean, and the means' distance from the mean of all.
    """
    digit = F.shiftright("key", _shift(0)).alias("prefix")
    counts = long.groupBy("m", digit).agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
    whole = Window.partitionBy("m")
    before = whole.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    n = F.col("n")
    counts = counts.withColumns({
        "before": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(whole),
        "least": F.min("lo").over(whole), "greatest": F.max("hi").over(whole),
        "all_mean": F.sum(F.col("mean") * n).over(whole) / F.sum("n").over(whole)})
    away = F.col("mean") - F.col("all_mean")
    return counts.withColumn("squares", F.sum(F.col("var") * n + n * away * away).over(whole))


def next_pass(long: DataFrame, level: int, prefixes: dict[int, list[int]]) -> DataFrame:
    """Counters by the digit of ``level`` under the given prefixes of each measure, with the values before."""
    above = F.shiftright("key", _shift(level - 1))
    inside = F.lit(False)
    for m, wanted in prefixes.items():
        inside = inside | ((F.col("m") == m) & above.isin(wanted))
    counts = long.where(inside).groupBy("m", F.shiftright("key", _shift(level)).alias("prefix")).agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    own = F.shiftright("prefix", BITS)
    before = Window.partitionBy("m", own).orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def _places(n: int, probs: Sequence[float]) -> list[tuple[int, int, float]]:
    """Per probability: the ranks around position (n - 1) p, from 0, and how far it lies between them."""
    out = []
    for p in probs:
        h = (n - 1) * float(p)
        out.append((math.floor(h), math.ceil(h), h - math.floor(h)))
    return out


def _holds(ranks: Sequence[int]) -> Column:
    """Whether a counter's values hold one of ``ranks``, counted under the counter's prefix."""
    found = F.lit(False)
    for r in ranks:
        found = found | ((F.col("before") <= r) & (r < F.col("before") + F.col("n")))
    return found


def summarize(df: DataFrame, measures: Sequence[str], probs: Sequence[float] = ()) -> list[Summary]:
    """A :class:`Summary` of each measure, with exact linear-interpolated quantiles at ``probs``.

    A quantile is SQL's ``percentile_cont``: with ``h = (n - 1) p``,
    ``v[floor h] + (h - floor h) (v[ceil h] - v[floor h])``, and the value itself
    where both are equal, so that an infinite value stays what it is.  Nulls and
    NaN are left out; a measure without values has a count of 0 and nothing else.
    """
    long = _long(df, measures)
    # Which ranks are wanted depends on n: the whole pass stays small enough to say so in the plan.
    first = first_pass(long)
    total = F.col("total")
    wanted = F.col("prefix").isNull()
    for p in probs:
        h = (total - 1).cast("double") * F.lit(float(p))
        for r in (F.floor(h), F.ceil(h)):
            wanted = wanted | ((F.col("before") <= r) & (r < F.col("before") + F.col("n")))
    found = first.where(wanted | (F.col("before") == 0)).collect()

    out = [Summary(quantiles=[None] * len(probs)) for _ in measures]
    for row in found:
        s = out[row.m]
        s.n, s.mean, s.least, s.greatest = row.total, row.all_mean, row.least, row.greatest
        s.stddev = math.sqrt(row.squares / (row.total - 1)) if row.total > 1 else None
    # rank of a measure -> its value, or the rank under the prefix that holds it
    ranks = {(m, r): (r, None) for m, s in enumerate(out) if s.n for a, b, _ in _places(s.n, probs) for r in (a, b)}
    values: dict[tuple[int, int], float] = {}
    for level in range(DIGITS):
        if level:
            prefixes: dict[int, list[int]] = {}
            for (m, _), (_, prefix) in ranks.items():
                if prefix not in prefixes.setdefault(m, []):
                    prefixes[m].append(prefix)
            counts = next_pass(long, level, prefixes)
            keep = F.lit(False)
            for (m, _), (rank, prefix) in ranks.items():
                keep = keep | ((F.col("m") == m) & (F.shiftright("prefix", BITS) == prefix) & _holds([rank]))
            found = counts.where(keep).collect()
        left = {}
        for (m, r), (rank, prefix) in ranks.items():
            row = next(x for x in found if x.m == m and (not level or x.prefix >> BITS == prefix)
                       and x.before <= rank < x.before + x.n)
            if row.lo == row.hi:
                values[m, r] = row.lo
            else:
                left[m, r] = (rank - row.before, row.prefix)
        ranks = left
        if not ranks:
            break
    for m, s in enumerate(out):
        if s.n:
            for i, (a, b, part) in enumerate(_places(s.n, probs)):
                low, high = values[m, a], values[m, b]
                s.quantiles[i] = low if low == high or part == 0 else low + part * (high - low)
    return out
