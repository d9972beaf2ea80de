"""Operator 6: embedding near-duplicates by iterative quantisation.

A rotation learned from a bounded sample turns vectors into balanced binary
codes.  The code is cut into ``TABLES`` parts, each the key of a Hamming table
in which a vector meets those whose part differs from its own in one bit at
most.  Pairs that meet are compared by their original vectors; a pair counts
in the first table in which it meets.  Exact copies are one entry throughout,
and large buckets are cut into cells of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fairlend.llm.components import connected_components
from fairlend.llm.tables import stored
from fairlend.llm.text import in_batches

TABLES = 4
#: Vectors that the rotation is learned from, at most; rounds of learning.
SAMPLE, ROUNDS = 20_000, 30
#: Rows of a bucket that are compared in one cell's block.
CELL = 1_024
_SEED = 20_240


def part_bits(n: int) -> int:
    """Bits of a table's key: buckets keep about one size while the collection grows; 14 at most."""
    return int(np.clip(np.ceil(np.log2(max(n, 2))) - 6, 6, 14))


class Rotation:
    """Centre, rotation and thresholds that turn vectors of one length into bits."""

    def __init__(self, sample: np.ndarray, dim: int, bits: int):
        bits = min(bits, dim)
        rng = np.random.default_rng([_SEED, dim])
        self.centre = sample.mean(0) if len(sample) else np.zeros(dim)
        centred = sample - self.centre
        if len(sample) > bits:
            _, _, axes = np.linalg.svd(centred.T @ centred)
            axes = axes[:bits].T
        else:
            axes = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :bits]
        flat = centred @ axes
        turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
        for _ in range(ROUNDS if len(sample) > bits else 0):
            left, _, right = np.linalg.svd(flat.T @ np.where(flat @ turn >= 0, 1.0, -1.0))
            turn = left @ right
        self.turn = axes @ turn
        self.middle = np.median(centred @ self.turn, axis=0) if len(sample) else np.zeros(bits)
        self.bits, self.tables = bits, min(TABLES, bits)

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables): each table's part of the bits as an integer."""
        tables = self.tables
        on = (unit - self.centre) @ self.turn >= self.middle
        out = np.zeros((len(unit), tables), np.int64)
        for k in range(self.bits):
            out[:, k % tables] |= on[:, k].astype(np.int64) << (k // tables)
        return out


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, sizes, starts) of a column of lists."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values, sizes, np.cumsum(sizes) - sizes


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision, without overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _usable(vector: str) -> F.Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return finite & F.exists(vector, lambda x: x != 0)


def _entries(vectors: DataFrame) -> DataFrame:
    """Distinct (label, vector) with a number ``rep``, ``copies`` and the smallest vec_id, ``first``."""
    return (vectors.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & _usable("vector"))
            .groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
            .withColumn("rep", F.monotonically_increasing_id()))


def learn(entries: DataFrame, bits: int) -> dict[int, Rotation]:
    """A rotation for each vector length of a sample of at most ``SAMPLE`` entries, taken by hash order."""
    rows = entries.select("vector").orderBy(F.xxhash64("vector", "label", F.lit(_SEED))).limit(SAMPLE).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r.vector), []).append(r.vector)
    return {dim: Rotation(unit_rows(np.array(x, np.float64)), dim, bits) for dim, x in by.items()}


def _met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two parts of a code differ in one bit at most."""
    differ = a ^ b
    return differ & (differ - 1) == 0


_ROW = "bucket binary, spot int, resident boolean, rep long, copies long, code binary, data binary"


def _index(entries: DataFrame, bits: int, models: dict[int, Rotation]) -> DataFrame:
    """A row per bucket that an entry stands in (its own part) or visits (one set bit cleared)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes, at = matrix(batch.column("vector"))
            kind = "<f4" if values.dtype == np.float32 else "<f8"
            labels = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            reps, copies = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rep", "copies"))
            for dim in np.unique(sizes).tolist():
                if dim not in models:
                    models[dim] = Rotation(np.zeros((0, dim)), dim, bits)
                own = np.flatnonzero(sizes == dim)
                for k in range(0, len(own), CELL):
                    rows = own[k:k + CELL]
                    x = values[at[rows][:, None] + np.arange(dim)]
                    codes = models[dim].codes(unit_rows(x))
                    out: dict[str, list] = {n: [] for n in ("bucket", "resident", "rep", "copies", "code", "data")}
                    for i, r in enumerate(rows.tolist()):
                        code, data = codes[i].astype("<i8").tobytes(), x[i].astype(kind).tobytes()
                        for t, part in enumerate(codes[i].tolist()):
                            for near in [part, *(part ^ 1 << b for b in range(part.bit_length()) if part >> b & 1)]:
                                out["bucket"].append(np.array([labels[r], dim, t, near], "<i8").tobytes())
                                out["resident"].append(near == part)
                                out["rep"].append(reps[r])
                                out["copies"].append(copies[r])
                                out["code"].append(code)
                                out["data"].append(data)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out["bucket"], pa.binary()), pa.nulls(len(out["rep"]), pa.int32()),
                         pa.array(out["resident"], pa.bool_()), pa.array(out["rep"], pa.int64()),
                         pa.array(out["copies"], pa.int64()), pa.array(out["code"], pa.binary()),
                         pa.array(out["data"], pa.binary())],
                        ["bucket", "spot", "resident", "rep", "copies", "code", "data"])

    return entries.transform(in_batches, run, _ROW)


def _compare(first: dict, second: dict | None, table: int, least: float) -> list[tuple[int, int, int]]:
    """(rep, other copies linked to it, smallest rep of its group) of the pairs of one cell.

    ``second`` is the cell's other block, None where a block meets itself.
    Visitors of a bucket do not meet each other in it.
    """
    a = first
    b = second or first
    close = a["unit"] @ b["unit"].T >= least
    close &= a["resident"][:, None] | b["resident"][None, :]
    if second is None:
        close &= ~np.tri(len(a["rep"]), dtype=bool)
    i, j = np.nonzero(close)
    for t in range(table):
        new = ~_met(a["code"][i, t], b["code"][j, t])
        i, j = i[new], j[new]
    if not len(i):
        return []
    reps, at = np.unique(np.concatenate([a["rep"][i], b["rep"][j]]), return_inverse=True)
    p, q = at[:len(i)], at[len(i):]
    linked = (np.bincount(p, b["copies"][j], len(reps)) + np.bincount(q, a["copies"][i], len(reps))).astype(np.int64)
    low = np.arange(len(reps))
    while True:
        least_of = np.minimum(low[p], low[q])
        new = low.copy()
        np.minimum.at(new, p, least_of)
        np.minimum.at(new, q, least_of)
        new = new[new]
        if (new == low).all():
            break
        low = new
    return list(zip(reps.tolist(), linked.tolist(), reps[low].tolist()))


def _links(cells: DataFrame, least: float) -> DataFrame:
    """(rep, linked, low) per cell, reps by number: partial counts of links and a star per group found in it."""
    def block(rows: list[dict]) -> dict:
        kind = "<f4" if rows[0]["narrow"] else "<f8"
        x = np.frombuffer(b"".join(r["data"] for r in rows), kind).reshape(len(rows), -1)
        return {"unit": unit_rows(x), "resident": np.array([r["resident"] for r in rows]),
                "rep": np.array([r["rep"] for r in rows], np.int64),
                "copies": np.array([r["copies"] for r in rows], np.int64),
                "code": np.frombuffer(b"".join(r["code"] for r in rows), "<i8").reshape(len(rows), -1)}

    def close(held: list[dict]) -> list[tuple[int, int, int]]:
        if len(held) < 2 or not any(r["resident"] for r in held):
            return []
        dim = int(np.frombuffer(held[0]["bucket"], "<i8")[1])
        for r in held:
            r["narrow"] = len(r["data"]) == 4 * dim
        table = int(np.frombuffer(held[0]["bucket"], "<i8")[2])
        i, j = held[0]["i"], held[0]["j"]
        first = block([r for r in held if r["spot"] == i])
        if i == j:
            return _compare(first, None, table, least)
        second = [r for r in held if r["spot"] == j]
        return _compare(first, block(second), table, least) if second and len(second) < len(held) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["rep", "linked", "low"])

        for batch in batches:
            for r in batch.to_pylist():
                now = (r["bucket"], r["i"], r["j"])
                if now != key:
                    if found := close(held):
                        yield out(found)
                    key, held = now, []
                held.append(r)
        if found := close(held):
            yield out(found)

    return cells.transform(in_batches, run, "rep long, linked long, low long")


def near_duplicates(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, vector, label).

    Rows with equal, non-null labels and a cosine of at least ``least`` in
    double precision link, if the tables bring them together: all pairs
    within one bit in a table do, so exact copies always.  Vectors that are
    null, empty, zero or hold null or non-finite components, vectors of
    different lengths, and rows without vec_id or label link with nothing.
    Rows that share a vec_id are rows of their own: each links with the other
    if they are close.  ``component_id`` is the smallest vec_id reachable,
    ``kept`` whether it is the row's own (null without a vec_id).  Extra
    columns are ignored; an empty table gives no rows.
    """
    vectors = vectors.select("vec_id", "vector", "label")
    entries = stored(_entries(vectors), "vectors")
    bits = TABLES * part_bits(entries.count())
    index = stored(_index(entries, bits, learn(entries, bits)), "hamming")
    # A bucket of m rows is cut into blocks of about CELL rows; each pair of blocks is a cell.
    large = stored(index.groupBy("bucket").agg(F.count("*").alias("m")).where(f"m > {CELL}")
                   .select("bucket", F.ceil(F.col("m") / CELL).cast("int").alias("blocks")), "hot-buckets")
    spot = F.pmod(F.xxhash64("rep"), F.coalesce("blocks", F.lit(1))).cast("int")
    cells = (index.join(large, "bucket", "left").withColumn("spot", spot)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
             .select("bucket", F.least("spot", "other").alias("i"), F.greatest("spot", "other").alias("j"),
                     "spot", "resident", "rep", "copies", "code", "data"))
    width = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.repartition(width, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = stored(_links(cells, least), "links")
    counts = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    groups = connected_components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")), "vector-groups")
    known = stored(entries.join(counts, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
                   .select(F.struct("label", "vector").alias("k"), "first", F.coalesce("component", "rep").alias("group"),
                           (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-links")
    lowest = known.groupBy("group").agg(F.min("first").alias("component"))
    known = known.join(lowest, "group").select("k", "n_links", "component")
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & _usable("vector")
    linked = vectors.where(usable).withColumn("k", F.struct("label", "vector")).join(known, "k")
    alone = vectors.where(~F.coalesce(usable, F.lit(False)))
    rows = (linked.select("vec_id", "n_links", F.col("component").alias("component_id"))
            .union(alone.select("vec_id", F.lit(0).cast("long"), "vec_id")))
    return rows.withColumn("kept", F.col("vec_id") == F.col("component_id"))


#: DuckDB SQL for the registered query.
ORACLE = r"""
with recursive good as (
  select row_number() over () as r, vec_id, label, embedding::double[] as v from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0
    and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
    and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links as (
  select a.r as a, b.r as b from good a join good b
  on a.label = b.label and len(a.v) = len(b.v) and a.r <> b.r and list_cosine_similarity(a.v, b.v) >= 0.93),
reach as (
  select r as a, r as b from good union select reach.a, links.b from reach join links on links.a = reach.b),
groups as (select reach.a as r, min(g.vec_id) as component_id from reach join good g on g.r = reach.b group by reach.a),
counts as (select a as r, count(*) as n_links from links group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from good join groups using (r) left join counts using (r)
union all
select vec_id, 0, vec_id, vec_id = vec_id from embeddings e
where not coalesce(vec_id is not null and label is not null and len(embedding) > 0
  and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
  and list_bool_or(list_transform(embedding, lambda x: x <> 0)), false)
"""
