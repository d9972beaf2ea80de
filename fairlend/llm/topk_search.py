"""Operator 1: exact top-k search by tiled matrix products.

Queries are cut into panels, candidates into shards, and each cell of the grid
panels x shards is one task: it holds its panel, streams its shard in packs,
multiplies the two, and keeps the best of each query.  The cells' lists are
merged by a tree of bounded fan-in.  A candidate is sent once per panel, a
query once per shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fairlend.llm.text import in_batches

#: Queries of a panel, candidates of a shard, rows of a pack, lists merged at once.
PANEL, SHARD, PACK, FAN_IN = 32_768, 65_536, 1_024, 16
#: Query rows multiplied with one pack at a time.
TILE = 2_048
SCALE = 256.0
_PACKED = "cell int, kind int, dim int, n int, ids binary, data binary, code string"


def _finite(vector: str) -> F.Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (F.size(vector) > 0) & good


def _pack(df: DataFrame, kind: int, cells) -> DataFrame:
    """Rows (vec_id, vector) as packs of equal length vectors, each for all cells that ``cells(batch)`` names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
            lists = batch.column("vector")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                for k in range(0, len(rows), PACK):
                    own = rows[k:k + PACK]
                    values = np.floor(SCALE * flat[at[own][:, None] + np.arange(dim)])
                    top = np.abs(values).max(initial=0)
                    code = "<i2" if top < 2 ** 15 else "<i4" if top < 2 ** 31 else "<f8"
                    serial += 1
                    for cell, pick in cells(ids[own], part * 7919 + serial):
                        chosen = values if pick is None else values[pick]
                        names = ids[own] if pick is None else ids[own][pick]
                        yield pa.RecordBatch.from_pydict({
                            "cell": pa.array([cell], pa.int32()), "kind": pa.array([kind], pa.int32()),
                            "dim": pa.array([dim], pa.int32()), "n": pa.array([len(names)], pa.int32()),
                            "ids": pa.array([names.astype("<i8").tobytes()], pa.binary()),
                            "data": pa.array([chosen.astype(code).tobytes()], pa.binary()),
                            "code": pa.array([code])})

    return df.transform(in_batches, run, _PACKED)


class _Best:
    """The best k of each query of one vector length, by (score descending, id ascending)."""

    def __init__(self, dim: int, k: int):
        self.dim, self.k, self.ids, self.parts = dim, k, [], []

    def add(self, ids: np.ndarray, values: np.ndarray) -> None:
        self.ids.append(ids)
        self.parts.append(values)

    def close(self) -> None:
        order = np.argsort(ids := np.concatenate(self.ids), kind="stable")
        self.queries, self.values = ids[order], np.concatenate(self.parts)[order]
        self.most = np.abs(self.values).max(initial=0)
        self.kind = np.float32
        self.scores = np.full((len(ids), self.k), -np.inf)
        self.found = np.full((len(ids), self.k), np.iinfo(np.int64).max)

    def meet(self, ids: np.ndarray, values: np.ndarray) -> None:
        bound = max(self.most, 1) * max(np.abs(values).max(initial=0), 1) * max(self.dim, 1)
        if bound >= 2 ** 53:
            return self._meet_large(ids, values)
        if bound >= 2 ** 24:
            self.kind = np.float64  # below, sums of integers are exact in single precision
        right = values.astype(self.kind).T
        for a in range(0, len(self.queries), TILE):
            own = slice(a, a + TILE)
            self._select(own, ids, self.values[own].astype(self.kind) @ right)

    def _meet_large(self, ids: np.ndarray, values: np.ndarray) -> None:
        """Products beyond what doubles hold exactly: integers of any size, held to the range of a long."""
        self.kind, self.scores = np.float64, self.scores.astype(np.longdouble)
        exact = np.array([[int(x) for x in row] for row in values], object).reshape(len(values), self.dim)
        for a in range(len(self.queries)):
            query = [int(x) for x in self.values[a]]
            score = [sum(p * q for p, q in zip(query, row)) for row in exact]
            score = np.array([min(max(s, -2 ** 63), 2 ** 63 - 1) for s in score], np.longdouble)
            self._select(slice(a, a + 1), ids, score[None, :])

    def _select(self, own: slice, ids: np.ndarray, score: np.ndarray) -> None:
        """Partial selection: what reaches the k-th place so far, or in this tile, joins the lists."""
        mine = self.queries[own]
        at = np.searchsorted(mine, ids)
        hit = np.flatnonzero((at < len(mine)) & (mine[np.minimum(at, len(mine) - 1)] == ids))
        score[at[hit], hit] = -np.inf  # a query is not its own answer
        least = self.scores[own, -1]
        if score.shape[1] > self.k:
            least = np.maximum(least, np.partition(score, -self.k, axis=1)[:, -self.k])
        row, col = np.nonzero((score >= least[:, None]) & (score > -np.inf))
        value, name = score[row, col].astype(self.scores.dtype), ids[col]
        keep = (value > self.scores[own, -1][row]) | (name < self.found[own, -1][row])
        row, value, name = row[keep], value[keep], name[keep]
        if not len(row):
            return
        touched = np.unique(row)
        rows = np.concatenate([row, np.repeat(touched, self.k)])
        values = np.concatenate([value, self.scores[own][touched].ravel()])
        names = np.concatenate([name, self.found[own][touched].ravel()])
        order = np.lexsort((names, -values, rows))
        rows, values, names = rows[order], values[order], names[order]
        first = np.searchsorted(rows, touched)
        pick = first[:, None] + np.arange(self.k)
        self.scores[own.start + touched] = values[pick]
        self.found[own.start + touched] = names[pick]


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows with the largest integer inner product for each query.

    Both inputs are (vec_id, vector).  A component x counts as floor(256 * x).
    Ties go to the smaller vec_id.  Vectors that are null, empty or hold a null or
    non-finite component, and rows without vec_id, take no part; vectors of
    different lengths have no product.  Rows that share a vec_id are one entry,
    the smallest vector of them, and no answer to a query of that vec_id.  A
    query without candidates gives no rows.  Scores beyond a long stop at its
    ends.
    """
    spark = rows.sparkSession

    def entries(df: DataFrame) -> DataFrame:
        return (df.select("vec_id", "vector").where(F.col("vec_id").isNotNull() & _finite("vector"))
                .groupBy("vec_id").agg(F.min("vector").alias("vector")))

    panels = max(1, -(-queries.count() // PANEL))
    n_rows = rows.count()
    shards = max(1, -(-n_rows // SHARD), min(spark.sparkContext.defaultParallelism, -(-n_rows // PACK)))

    def query_cells(ids, serial):
        mixed = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        panel = (mixed % np.uint64(panels)).astype(np.int64)
        for p in np.unique(panel).tolist():
            for s in range(shards):
                yield p * shards + s, panel == p

    def row_cells(ids, serial):
        for p in range(panels):
            yield p * shards + serial % shards, None

    packs = _pack(entries(queries), 0, query_cells).union(_pack(entries(rows), 1, row_cells))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        cell, open_ = 0, True
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                cell = r["cell"]
                ids = np.frombuffer(r["ids"], "<i8")
                values = np.frombuffer(r["data"], r["code"]).reshape(r["n"], r["dim"])
                if r["kind"] == 0:
                    best.setdefault(r["dim"], _Best(r["dim"], k)).add(ids, values.astype(np.float64))
                    continue
                if open_:
                    open_ = False
                    for b in best.values():
                        b.close()
                if r["dim"] in best:
                    best[r["dim"]].meet(ids, values)
        for b in best.values() if not open_ else ():
            for a in range(0, len(b.queries), TILE):
                score, found = b.scores[a:a + TILE].ravel(), b.found[a:a + TILE].ravel()
                good = np.flatnonzero(score > -np.inf)
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(np.repeat(b.queries[a:a + TILE], k)[good], pa.int64()),
                    "branch": pa.array(np.full(len(good), cell % shards), pa.int32()),
                    "vec_id": pa.array(found[good], pa.int64()),
                    "score": pa.array(score[good].astype(np.int64), pa.int64())})

    lists = (packs.repartitionById(panels * shards, "cell").sortWithinPartitions("cell", "kind")
             .transform(in_batches, search, "query_id long, branch int, vec_id long, score long")
             .groupBy("query_id", "branch")
             .agg(F.collect_list(F.struct(F.negate("score").alias("low"), "vec_id")).alias("top")))
    width = shards
    while True:
        width = -(-width // FAN_IN)
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top")
        lists = lists.groupBy("query_id", (F.col("branch") / FAN_IN).cast("int").alias("branch")).agg(merged)
        if width == 1:
            break
    return (lists.select("query_id", F.posexplode("top").alias("pos", "hit"))
            .select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"),
                    F.negate("hit.low").alias("score")))


#: DuckDB SQL for the registered query over the table embeddings.
ORACLE = """
with parts as (
  select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x,
    len(embedding) as dim from embeddings where vec_id is not null),
good as (
  select vec_id from parts group by vec_id having count(*) = min(dim)
    and bool_and(x is not null and isfinite(x))),
whole as (select vec_id, dim, i, floor(256 * x)::bigint as v from parts semi join good using (vec_id)),
scores as (
  select q.vec_id as query_id, c.vec_id, sum(q.v * c.v)::bigint as score
  from whole q join whole c on q.i = c.i and q.dim = c.dim and q.vec_id <> c.vec_id
  where q.vec_id % 50 = 0 group by all),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scores)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""
