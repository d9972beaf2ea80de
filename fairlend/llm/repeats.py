"""Windows of units that start at two places or more, found over all documents.

Shared by the two substring operators.  A unit is a word (as a 64-bit hash) or
a byte; a window is ``window`` consecutive units of one document.

* Every window has an anchor: of the grams of ``gram`` units inside it, the
  one with the smallest hash, leftmost first.  Equal windows have equal
  anchors at equal distances, so a window can repeat only where its anchor
  does.  Neighbouring windows with one anchor form a segment.
* Segments meet by anchor.  Equal segments (compared by hash) are repeated as
  a whole and are combined within a task before any shuffle; what a task finds
  so only travels to its document.  A segment whose anchor occurs nowhere else
  is unique and leaves the job.
* Anchors are counted first.  One with more than ``wide`` rows meets no task:
  its equal segments are aggregated, then its different segments are counted.
* Different segments with one anchor are compared unit by unit by the
  operator's own method, in groups that fit in memory.
* Where more than ``wide`` different segments share an anchor, the windows go
  on alone, each by the hash of all its units, which spreads them again; equal
  windows are aggregated too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fairlend.llm.tables import stored
from fairlend.llm.text import chunks, in_batches

FULL, COMPARE, CONTEXT, WINDOW, ROW = range(5)
_ROW = "kind int, key long, seg long, many boolean, doc_id long, tag long, s long, n long"
_NAMES = ["kind", "key", "seg", "many", "doc_id", "tag", "s", "n"]
#: Segments a task holds before it combines and passes them on.
HELD = 200_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93,
                               0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


@dataclass(frozen=True)
class Windows:
    """``units``: text column of a batch -> (array of units, where each row's begin and the last's end)."""

    window: int
    gram: int  # a power of two
    units: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
    wide: int


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * _MIX[1]
    h = (h ^ h >> np.uint64(27)) * _MIX[2]
    return h ^ h >> np.uint64(31)


def gram_hashes(units: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every ``gram`` consecutive units, by doubling."""
    h = _mixed((units.astype(np.uint64) + np.uint64(1)) * _MIX[0])
    size, level = 1, 0
    while size < gram:
        if len(h) <= size:
            return h[:0]
        h = h[:-size] * _MIX[2 + level % 5] + h[size:]
        size, level = 2 * size, level + 1
    return _mixed(h)


def segments(units: np.ndarray, at: np.ndarray, w: Windows) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, anchor hash) of each segment; ``at``: where rows begin, and the end."""
    none = np.zeros(0, np.int64)
    grams = gram_hashes(units, w.gram)
    span = w.window - w.gram + 1
    starts = len(units) - w.window + 1
    if starts <= 0:
        return none, none, none, none.astype(np.uint64)
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    low = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:starts], low[span - size:span - size + starts])
    anchor = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[:starts]
    good = np.flatnonzero(np.arange(starts) + w.window <= at[1:][row])
    if not len(good):
        return none, none, none, none.astype(np.uint64)
    fresh = np.ones(len(good), bool)
    fresh[1:] = (anchor[good[1:]] != anchor[good[:-1]]) | (row[good[1:]] != row[good[:-1]])
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(good)))
    first = good[first]
    return row[first], first, count, grams[anchor[first]]


def _digests(units: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    raw, width = memoryview(np.ascontiguousarray(units).view(np.uint8)), units.itemsize
    a, b = (first * width).tolist(), ((first + size) * width).tolist()
    return np.fromiter((xxhash.xxh3_64_intdigest(raw[i:j]) for i, j in zip(a, b)), np.uint64, len(a)).view(np.int64)


def _batch(kind, key, seg, many, doc_id, tag, s, n) -> pa.RecordBatch:
    size = len(key)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.broadcast_to(np.asarray(kind, np.int32), size)), pa.array(key), pa.array(seg),
         pa.array(np.broadcast_to(np.asarray(many, bool), size)), doc_id if isinstance(doc_id, pa.Array) else pa.array(doc_id),
         pa.array(tag), pa.array(s), pa.array(n)], _NAMES)


def combine(key, seg, doc_id: pa.Array, tag, s, n) -> Iterator[pa.RecordBatch]:
    """What a task passes on of its segments: one row per different segment, and known repeats."""
    order = np.lexsort((seg, key))
    key, seg, tag, s, n = (x[order] for x in (key, seg, tag, s, n))
    doc_id = doc_id.take(pa.array(order))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (seg[1:] != seg[:-1])
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1
    full = np.flatnonzero(many)
    if len(full):
        # Known repeats only travel to their document; neighbouring ones as one.
        plain, absent = doc_id.fill_null(0).to_numpy(), doc_id.is_null().to_numpy(zero_copy_only=False)
        back = full[np.lexsort((s[full], tag[full], absent[full], plain[full]))]
        ids = doc_id.take(pa.array(back))
        same = [x[back] for x in (plain, absent, tag)]
        t, a, b = tag[back], s[back], s[back] + n[back]
        fresh = np.ones(len(back), bool)
        fresh[1:] = np.any([x[1:] != x[:-1] for x in same], axis=0) | (a[1:] != b[:-1])
        at = np.flatnonzero(fresh)
        ends = b[np.append(at[1:], len(back)) - 1]
        zero = np.zeros(len(at), np.int64)
        yield _batch(FULL, zero, zero, True, ids.take(pa.array(at)), t[at], a[at], ends - a[at])
    rows = np.flatnonzero(new)
    yield _batch(ROW, key[rows], seg[rows], many[rows], doc_id.take(pa.array(rows)), tag[rows], s[rows], n[rows])


def _find(docs: DataFrame, w: Windows) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            parts = list(zip(*held))
            ids = pa.concat_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in parts[2]])
            key, seg, tag, s, n = (np.concatenate(parts[i]) for i in (0, 1, 3, 4, 5))
            yield from combine(key, seg, ids, tag, s, n)

        for whole in batches:
            for batch in chunks(whole, "text"):
                units, at = w.units(batch.column("text"))
                row, first, count, anchor = segments(units, at, w)
                if len(row):
                    seg = _digests(units, first, count + w.window - 1)
                    tag = batch.column("tag").to_numpy()
                    held.append((anchor.view(np.int64), seg, batch.column("doc_id").take(pa.array(row)), tag[row],
                                 first - at[row], count))
                    size += len(row)
                    if size >= HELD:
                        yield from close()
                        held, size = [], 0
        if held:
            yield from close()

    return docs.transform(in_batches, run, _ROW)


def _meet(rows: DataFrame) -> DataFrame:
    """Segments that met by key: FULL repeats and what has to be compared.

    ``rows`` has no key with more than ``wide`` rows.  A task streams its keys
    in order and holds one key at a time and a batch.
    """
    def settle(c: dict[str, np.ndarray], doc_id: pa.Array) -> Iterator[pa.RecordBatch]:
        at = np.lexsort((c["seg"], c["key"]))
        key, seg = c["key"][at], c["seg"][at]
        new_key = np.ones(len(at), bool)
        new_key[1:] = key[1:] != key[:-1]
        owner = np.cumsum(new_key) - 1
        new = new_key.copy()
        new[1:] |= seg[1:] != seg[:-1]
        group = np.cumsum(new) - 1
        copies = np.bincount(group, 1 + c["many"][at].astype(np.int64))[group]
        different = np.bincount(owner, new)[owner]
        for kind, pick in ((FULL, at[copies > 1]), (COMPARE, at[(different > 1) & (copies == 1)]),
                           (CONTEXT, at[(different > 1) & (copies > 1) & new])):
            if len(pick):
                yield _batch(kind, c["key"][pick], c["seg"][pick], c["many"][pick], doc_id.take(pa.array(pick)),
                             c["tag"][pick], c["s"][pick], c["n"][pick])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def columns(parts):
            whole = pa.Table.from_batches(parts).combine_chunks()
            got = {x: whole[x].combine_chunks().to_numpy(zero_copy_only=False) for x in _NAMES if x != "doc_id"}
            ids = whole["doc_id"].combine_chunks()
            return got, ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            begin = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if begin:
                yield from settle(*columns([*held, batch.slice(0, begin)]))
                held = [batch.slice(begin)]
            else:
                if held and held[-1].column("key")[0].as_py() != int(key[0]):
                    yield from settle(*columns(held))
                    held = []
                held.append(batch)
        if held:
            yield from settle(*columns(held))

    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(width, "key").sortWithinPartitions("key").transform(in_batches, run, _ROW)


def _copies(rows: DataFrame) -> DataFrame:
    """(key, seg, copies, one of the rows) of equal segments or windows, partly aggregated before any shuffle."""
    return rows.groupBy("key", "seg").agg(F.sum(F.lit(1) + F.col("many").cast("int")).alias("copies"),
                                          F.min(F.struct("doc_id", "tag", "s", "n")).alias("one"))


def _spread(rows: DataFrame, wide: int, name: str) -> DataFrame:
    """What ``_meet`` gives, for keys of any number of rows; segments of wide keys go on by window.

    No task gathers a key: its rows join tables with one row per key or per
    different segment, where Spark deals out what is skewed.
    """
    different = stored(_copies(rows), name)
    full = rows.join(different.where("copies > 1").select("key", "seg"), ["key", "seg"], "left_semi")
    per_key = stored(different.groupBy("key").agg(F.count("*").alias("different")).where("different > 1"), name)
    kind = (F.when(F.col("different") > wide, WINDOW).when(F.col("copies") > 1, CONTEXT).otherwise(COMPARE))
    asked = (different.join(per_key, "key")
             .select(kind.alias("kind"), "key", "seg", (F.col("copies") > 1).alias("many"), "one.*"))
    return full.withColumn("kind", F.lit(FULL)).select(*_NAMES).union(asked.select(*_NAMES))


_PART = "kind int, key long, seg long, many boolean, doc_id long, tag long, s long, n long, data binary"


def _same(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on doc_id (nulls meet) and tag; ``right`` has them as r_id and r_tag."""
    on = F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("tag") == F.col("r_tag"))
    return left.join(right, on, how).drop("r_id", "r_tag")


def _fetch(docs: DataFrame, asked: DataFrame, w: Windows) -> DataFrame:
    """The asked segments with their units, and the hashes of the windows that go on alone."""
    wanted = (asked.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("kind", "key", "s", "n")).alias("asked"))
              .select(F.col("doc_id").alias("r_id"), F.col("tag").alias("r_tag"), "asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                units, at = w.units(batch.column("text"))
                asks, tag = batch.column("asked").to_pylist(), batch.column("tag").to_numpy()
                out, win = [], []
                for i, found in enumerate(asks):
                    for a in found:
                        lo = int(at[i]) + a["s"]
                        if a["kind"] == WINDOW:
                            p = np.arange(lo, lo + a["n"])
                            size = np.full(len(p), w.window)
                            seg = _digests(units, p, size)
                            raw = units[lo:lo + a["n"] + w.window - 1]
                            other = _mixed(seg.view(np.uint64) + _window_sums(raw, w.window)).view(np.int64)
                            win.append((other, seg, np.full(len(p), i), p - at[i]))
                        else:
                            data = units[lo:lo + a["n"] + w.window - 1].tobytes()
                            out.append((a["kind"], a["key"], i, a["s"], a["n"], data))
                if out:
                    kind, key, row, s, n, data = zip(*out)
                    row = np.array(row)
                    got = _batch(np.array(kind, np.int32), np.array(key), np.zeros(len(out), np.int64), False,
                                 batch.column("doc_id").take(pa.array(row)), tag[row], np.array(s), np.array(n))
                    yield pa.RecordBatch.from_arrays([*got.columns, pa.array(data, pa.binary())], [*_NAMES, "data"])
                if win:
                    key, seg, row, s = (np.concatenate(x) for x in zip(*win))
                    ids = batch.column("doc_id").take(pa.array(row))
                    for got in combine(key, seg, ids, tag[row], s, np.ones(len(s), np.int64)):
                        yield pa.RecordBatch.from_arrays([*got.columns, pa.nulls(got.num_rows, pa.binary())],
                                                         [*_NAMES, "data"])

    return _same(docs.select("doc_id", "tag", "text"), wanted, "inner").transform(in_batches, run, _PART)


def _window_sums(units: np.ndarray, window: int) -> np.ndarray:
    """Per window the sum of position-weighted unit hashes: a second hash beside the digest."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(units.astype(np.uint64) * _MIX[5] + _MIX[6]),
                                                             dtype=np.uint64)])
    return total[window:] - total[:-window]


def repeated_spans(docs: DataFrame, w: Windows, compare: Callable, name: str) -> DataFrame:
    """(doc_id, tag, spans): per document with repeated windows, lists of (s, n): n windows from unit s on.

    ``docs``: doc_id, tag (a hash of the text), text.  ``compare`` takes the
    rows of one key or several (key, context, units) in order of key and gives
    (row, first window, windows) of those that repeat among them.
    """
    found = stored(_find(docs, w), name)
    rows = found.where(F.col("kind") == ROW)
    hot = stored(rows.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > w.wide).select("key"), name)
    met = stored(_meet(rows.join(hot, "key", "left_anti").select(*_NAMES))
                 .union(_spread(rows.join(hot, "key", "left_semi").select(*_NAMES), w.wide, name)), name)
    asked = met.where(F.col("kind").isin(COMPARE, CONTEXT, WINDOW))
    parts = stored(_fetch(docs, asked, w), name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, key = [], 0, None

        def close() -> Iterator[pa.RecordBatch]:
            found = list(compare([r["data"] for r in held], [r["kind"] == CONTEXT for r in held]))
            found = [(held[i], s, n) for i, s, n in found if held[i]["kind"] != CONTEXT]
            if found:
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([r["doc_id"] for r, _, _ in found], pa.int64()),
                    "tag": pa.array([r["tag"] for r, _, _ in found], pa.int64()),
                    "s": pa.array([r["s"] + s for r, s, _ in found], pa.int64()),
                    "n": pa.array([n for *_, n in found], pa.int64())})

        for batch in batches:
            for r in batch.to_pylist():
                if r["key"] != key and size >= PACK_BYTES:
                    yield from close()
                    held, size = [], 0
                key = r["key"]
                held.append(r)
                size += len(r["data"])
        if held:
            yield from close()

    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    compared = (parts.where(F.col("kind").isin(COMPARE, CONTEXT)).select("kind", "key", "doc_id", "tag", "s", "n", "data")
                .repartition(width, "key").sortWithinPartitions("key", "s", "tag")
                .transform(in_batches, run, "doc_id long, tag long, s long, n long"))
    alone = parts.where(F.col("kind") == ROW)
    alone = alone.join(_copies(alone).where("copies > 1").select("key", "seg"), ["key", "seg"], "left_semi")
    full = [x.select("doc_id", "tag", "s", "n") for x in (*(y.where(F.col("kind") == FULL) for y in (found, met, parts)), alone)]
    return (reduce(DataFrame.union, full, compared).groupBy("doc_id", "tag")
            .agg(F.collect_set(F.struct("s", "n")).alias("spans")))


#: Bytes of units that ``compare`` gets at once, and one key more.
PACK_BYTES = 1 << 20


def covered(spans: list[dict] | None, size: int, window: int) -> np.ndarray:
    """Which of ``size`` units the windows of ``spans`` cover."""
    change = np.zeros(size + 1, np.int64)
    if spans:
        s = np.array([x["s"] for x in spans])
        n = np.array([x["n"] for x in spans])
        np.add.at(change, s, 1)
        np.add.at(change, s + n + window - 1, -1)
    return np.cumsum(change[:-1]) > 0


def cut(docs: DataFrame, w: Windows, compare: Callable, apply: Callable, fields: str, name: str) -> DataFrame:
    """``docs`` (doc_id, text and more) with the columns ``fields`` that ``apply`` makes.

    ``apply(texts column, masks)`` gets for each row which of its units go and
    returns a list per field.  Rows that share doc_id and text share their
    spans, which are the same for both.
    """
    names = docs.columns
    tagged = docs.withColumn("tag", F.xxhash64("text")) if "tag" not in names else \
        docs.withColumnRenamed("tag", "_tag").withColumn("tag", F.xxhash64("text"))
    plain = tagged.select("doc_id", "tag", F.coalesce("text", F.lit("")).alias("text"))
    spans = repeated_spans(plain, w, compare, name).select(
        F.col("doc_id").alias("r_id"), F.col("tag").alias("r_tag"), "spans")
    rest = [f for f in tagged.columns if f != "tag"]
    joined = _same(tagged, spans, "left").select(*(F.col(f"`{c}`") for c in rest), F.col("spans").alias("_spans"))
    added = [x.split()[0] for x in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                units, at = w.units(batch.column("text"))
                masks = [covered(x, int(b - a), w.window)
                         for x, a, b in zip(batch.column("_spans").to_pylist(), at, at[1:])]
                made = apply(batch.column("text"), masks)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*rest, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-1])
    out = joined.transform(in_batches, run, f"{schema}, {fields}")
    return out.withColumnRenamed("_tag", "tag") if "tag" in names else out
