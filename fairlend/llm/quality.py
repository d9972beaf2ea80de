"""Operator 5: selection of quality text by importance resampling.

Two generative models give the probability of a text as the product of those
of its hashed n-grams: one of target text, one of raw text.  The log of their
ratio is a row's importance weight, and Gumbel noise turns the k largest sums
of weight and noise into a sample without replacement in proportion to the
weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fairlend.llm.repeats import gram_hashes
from fairlend.llm.tables import stored
from fairlend.llm.text import byte_view, chunks, in_batches
from fairlend.llm.toxicity import is_held_out

#: Bytes of an n-gram, buckets they are hashed to, target rows that the target model counts at most.
GRAM, BUCKETS, TARGET_ROWS = 4, 1 << 16, 20_000
#: Share of all rows that the sample keeps.
KEEP = 0.85
#: Rows that one task orders at the cut, and bins of a step towards it.
AT_CUT, BINS, SEED = 10_000, 1_024, 11
_BLOCK = 1 << 13


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of bytes of each text, A-Z in lower case."""
    data, at = byte_view(column)
    at, data = at - at[0], data[at[0]:at[-1]]
    data = np.where((data >= 65) & (data <= 90), data + 32, data)
    grams = gram_hashes(data, GRAM)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[:len(grams)]
    good = np.arange(len(grams)) + GRAM <= at[1:][row]
    return row[good], (grams[good] % np.uint64(BUCKETS)).astype(np.int64)


def count_grams(docs: DataFrame) -> np.ndarray:
    """N-grams per bucket over all rows of ``docs`` (text); ``BUCKETS`` numbers reach the driver."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for whole in batches:
            for batch in chunks(whole, "text"):
                total += np.bincount(_grams(batch.column("text"))[1], minlength=BUCKETS)
        at = range(0, BUCKETS, _BLOCK) if total.any() else []
        yield pa.RecordBatch.from_pydict({"k": pa.array(list(at), pa.int32()),
                                          "n": pa.array([total[k:k + _BLOCK].tobytes() for k in at], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, n in zip(batch.column("k").to_pylist(), batch.column("n").to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(n, np.int64)
        yield pa.RecordBatch.from_pydict({"k": pa.array(list(total), pa.int32()),
                                          "n": pa.array([x.tobytes() for x in total.values()], pa.binary())})

    schema = "k int, n binary"
    rows = docs.select("text").transform(in_batches, local, schema).repartition(BUCKETS // _BLOCK, "k").mapInArrow(add, schema)
    out = np.zeros(BUCKETS, np.int64)
    for r in rows.collect():
        out[r.k:r.k + _BLOCK] = np.frombuffer(r.n, np.int64)
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of the target's over the raw text's probability of each bucket, both counts one higher; 0 without target text."""
    if not target.any():
        return np.zeros(len(raw))
    p, q = target + 1.0, raw + 1.0
    return np.log(p / p.sum()) - np.log(q / q.sum())


def target_text(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of rows of ``labels`` (doc_id, quality) of quality 1 that are not held out: the first
    ``TARGET_ROWS`` ids by a hash, a bound on what is broadcast."""
    ids = (labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
           .select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(TARGET_ROWS))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text")


def log_weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(doc_id, tag, n_grams, log_weight): the sum of the log ratios of all n-grams of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                row, bucket = _grams(batch.column("text"))
                n = np.bincount(row, minlength=batch.num_rows)
                weight = np.bincount(row, ratios[bucket], batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(n.astype(np.int64)),
                                                  pa.array(weight)], ["doc_id", "tag", "n_grams", "log_weight"])

    return docs.select("doc_id", F.xxhash64("text", F.lit(SEED)).alias("tag"), "text").transform(in_batches, 
        run, "doc_id long, tag long, n_grams long, log_weight double")


def gumbel(*seeds: Column) -> Column:
    """Standard Gumbel noise from a hash of ``seeds``; reruns agree."""
    u = (F.pmod(F.xxhash64(*seeds), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)
    return -F.log(-F.log(u))


def top_k_flag(rows: DataFrame, key: str, ties: list[str], k: int, out: str) -> DataFrame:
    """``rows`` with a boolean ``out``: among the ``k`` largest of ``key``, ties by ``ties`` ascending, nulls first.

    Counts in equal bins narrow down where the k-th key lies until ``AT_CUT``
    rows or one value are left; only the rows of that bin are ordered in one
    task.  Keys that hash a row's id and text leave one value to equal rows.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    above = 0
    while low is not None and low < high:
        width = (high - low) / BINS
        if low + width == low or low + width * (BINS - 1) >= high:
            break
        place = F.least(F.floor((F.col(key) - low) / width), F.lit(BINS - 1)).cast("int")
        inside = rows.where((F.col(key) >= low) & (F.col(key) <= high)).groupBy(place.alias("bin")).agg(
            F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        found = None
        for r in sorted(inside.collect(), key=lambda r: -r.bin):
            if above + r.n >= k:
                found = r
                break
            above += r.n
        if found is None:
            low = None
            break
        low, high = found.lo, found.hi
        if found.n <= AT_CUT:
            break
    if low is None or k <= 0:
        return rows.withColumn(out, F.lit(k > 0))
    at_cut = rows.where((F.col(key) >= low) & (F.col(key) <= high))
    order = [F.col(key).desc(), *(F.col(c).asc_nulls_first() for c in ties)]
    ranked = at_cut.withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
    return (rows.where(F.col(key) > high).withColumn(out, F.lit(True))
            .union(ranked.select(*rows.columns, (F.col("_rank") <= k - above).alias(out)))
            .union(rows.where(F.col(key) < low).withColumn(out, F.lit(False))))


def resample(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, held_out, n_grams, log_weight, key, kept of every row of ``docs`` (doc_id, text).

    ``kept`` marks the sample: the floor of ``keep`` times the number of rows,
    by the largest ``key``, the log weight plus Gumbel noise that comes from
    doc_id and text.  Null, empty and very short texts have no n-grams and
    weight 0; without target rows all weights are 0.  Counts cover all rows;
    ties go to the smaller doc_id, nulls first.  Repeated rows have equal keys.
    Other columns are ignored; an empty table gives no rows.
    """
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ratios = log_ratios(count_grams(target_text(plain, labels)), count_grams(plain))
    rows = stored(log_weights(plain, ratios).withColumn(
        "key", F.col("log_weight") + gumbel(F.coalesce("doc_id", F.lit(-1)), F.col("tag"))), "weights")
    flagged = top_k_flag(rows, "key", ["doc_id", "tag"], int(keep * rows.count()), "kept")
    return flagged.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "n_grams", "log_weight", "key", "kept")
