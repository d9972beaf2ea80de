"""Operator 2: mixing sources to target weights.

Every row gets a hash-random key.  Within a source the rows are ordered by
that key; sums of words per key range, and their running sums, show the range
in which the source's budget ends, and a running sum inside that one range
gives the cut row.  A budget above the source's size takes whole epochs first.
Only built-in DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fairlend.llm.tables import stored

#: A word, as a regular expression.
WORD = r"[^\x20\x09-\x0D]+"
#: About so many rows share a key range; bounds what one task sorts.
ROWS_PER_RANGE = 2_000
#: Bits of a row's key.
KEY_BITS = 60


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(doc_id: Column, text: Column) -> Column:
    """60 bits of the md5 of id and text; equal for equal rows only."""
    digest = F.md5(F.concat_ws("\n", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """(source, source_size, n_rows, target) from one row (source, source_size, n_rows) per source.

    Sources in code-point order, null last, weigh ``weights``, repeating.  They
    share the sum of all sizes by weight; a target above ``max_epochs`` times
    its source's size stops there and the excess is shared again among the
    rest, until none is above.
    """
    order = F.col("source").asc_nulls_last()
    width = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(sizes.repartitionByRange(width, order).withColumn("part", F.spark_partition_id()), "mix-sources")
    # Rank of a source: the sources of earlier parts (a row per part), and its place in its own part.
    parts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    table = stored(ranged.join(before, "part")
                   .withColumn("rank", F.col("before") + place - 1)
                   .select("source", "source_size", "n_rows", weight.cast("long").alias("weight"),
                           (F.col("source_size") * max_epochs).alias("most"), F.lit(False).alias("full")), "mix-weights")
    while True:
        left = table.agg(
            (F.sum("source_size") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))), F.lit(0))).alias("words"),
            F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(0)).alias("weight")).first()
        words, total = left.words or 0, left.weight
        share = F.lit(float(words)) * F.col("weight") / F.lit(float(total or 1))
        above = ~F.col("full") & (share > F.col("most"))
        if table.where(above).isEmpty():
            target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(share)
            return table.select("source", "source_size", "n_rows", target.alias("target"))
        table = stored(table.withColumn("full", F.col("full") | above), "mix-shares")


def _plan(rows: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """Per source: source_size, target, epochs, cut (key of the row where the budget ends) and the words left for it.

    ``rows``: (source, key, size).
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0).cast("long")
    plan = (source_targets(sizes, weights, max_epochs).withColumn("budget", budget).withColumn("epochs", epochs)
            .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
            .withColumn("ranges", F.ceil(F.col("n_rows") / ROWS_PER_RANGE).cast("long")))
    plan = stored(plan, "mix-plan")
    # Key range of a row: its key's first 40 bits times the source's number of ranges.
    place = F.shiftright(F.shiftright("key", KEY_BITS - 40) * F.col("ranges"), 40)
    open_ = plan.where("rest > 0").select(F.col("source").alias("s"), "ranges", "rest")
    ranged = rows.join(open_, F.col("source").eqNullSafe(F.col("s"))).select("s", "rest", "key", "size", place.alias("range"))
    sums = ranged.groupBy("s", "rest", "range").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ends = (sums.withColumn("upto", F.sum("words").over(running))
            .where("upto >= rest and upto - words < rest")
            .select(F.col("s").alias("e"), F.col("range").alias("r"), (F.col("upto") - F.col("words")).alias("before")))
    # In the one range per source where the budget ends: equal keys together, then a running sum.
    inside = (ranged.join(ends, F.col("s").eqNullSafe(F.col("e")) & (F.col("range") == F.col("r")))
              .groupBy("s", "rest", "before", "key").agg(F.sum("size").alias("words"), F.count("*").alias("n")))
    running = Window.partitionBy("s").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (inside.withColumn("upto", F.col("before") + F.sum("words").over(running))
            .where("upto >= rest and upto - words < rest")
            .select(F.col("s").alias("c"), F.col("key").alias("cut"),
                    F.expr("(rest - (upto - words)) div n").alias("at_cut")))
    return stored(plan.join(cuts, F.col("source").eqNullSafe(F.col("c")), "left")
                  .select(F.col("source").alias("plan_source"), "source_size", "target", "epochs", "cut", "at_cut"),
                  "mix-cuts")


_TAKEN = ("epochs * size + case when cut is null or key > cut then 0 when key < cut then size "
          "else at_cut end")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of ``docs`` (doc_id, text, source).

    ``taken`` counts the words that the mix takes of a row: its size for each
    whole epoch, and in the last epoch its size before the cut, what is left
    of the budget at the cut, and nothing after it.  The words taken of a
    source are its target, rounded; equal rows at the cut share what is left
    evenly, in whole words.  A null text has size 0 and a source without words
    a target of 0; nulls in source are a source of their own; an empty table
    gives no rows.  Other columns are ignored.  Reruns agree: keys come from
    doc_id and text.
    """
    rows = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"),
                              row_key(F.col("doc_id"), F.col("text")).alias("key")), "mix-rows")
    plan = _plan(rows.select("source", "key", "size"), weights, max_epochs)
    return (rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
            .select("doc_id", "size", "source_size", "target", F.expr(_TAKEN).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """The mix itself: ``docs`` with each row as often as the mix takes it, same columns.

    The row at a source's cut comes with its first words only, joined by a
    blank, and n_chars, if there is such a column, counts what is left.  Texts are not shuffled: a source's cut is a row
    of a small table.
    """
    names = docs.columns
    keyed = docs.withColumns({"_size": n_words(F.col("text")), "_key": row_key(F.col("doc_id"), F.col("text"))})
    rows = stored(keyed.select("source", F.col("_key").alias("key"), F.col("_size").alias("size")), "mix-rows")
    plan = _plan(rows, weights, max_epochs).select(*(F.col(c).alias(f"_{c}") for c in (
        "plan_source", "epochs", "cut", "at_cut")))
    taken = F.expr("_epochs * _size + case when _cut is null or _key > _cut then 0 when _key < _cut then _size "
                   "else _at_cut end")
    part = F.expr("_taken - (_taken div _size) * _size")
    copies = F.expr("cast(_taken div _size + if(_taken % _size > 0, 1, 0) as int)")
    out = (keyed.join(plan, F.col("source").eqNullSafe(F.col("_plan_source"))).withColumn("_taken", taken)
           .where("_taken > 0").withColumn("_part", part)
           .withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))))
    cut_here = (F.col("_part") > 0) & (F.col("_copy") * F.col("_size") > F.col("_taken"))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1),
                                 F.greatest(F.col("_part"), F.lit(1)).cast("int")), " ")
    text = F.when(cut_here, first).otherwise(F.col("text"))
    size = {"n_chars": F.when(cut_here, F.length(text)).otherwise(F.col("n_chars"))} if "n_chars" in names else {}
    return out.select(*(text.alias(c) if c == "text" else size[c].cast(docs.schema[c].dataType).alias(c)
                        if c in size else F.col(f"`{c}`") for c in names))


#: DuckDB SQL for ``mix`` over the table documents.
ORACLE = r"""
with rows as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '') || chr(10) || coalesce(text, '')), 1, 15))::bigint as key
  from documents),
sources as (
  select source, sum(size)::bigint as source_size,
    [5, 2, 1][1 + (row_number() over (order by source collate "C" nulls last) - 1) % 3] as weight
  from rows group by source),
filled as (
  select *, sum(source_size) over () as total, sum(weight) over () as weights,
    coalesce(sum(3 * source_size) over w, 0) as most_before, coalesce(sum(weight) over w, 0) as weight_before,
    row_number() over (order by source_size / weight, source) as place
  from sources
  window w as (order by source_size / weight, source rows between unbounded preceding and 1 preceding)),
level as (
  select min(place) as place from filled
  where (total - most_before)::double * weight / (weights - weight_before)::double <= 3 * source_size),
open_share as (
  select (total - most_before)::double as words, (weights - weight_before)::double as weight
  from filled where place = (select place from level)),
targets as (
  select f.source, f.source_size, case when f.place < coalesce(l.place, 9223372036854775807)
      then (3 * f.source_size)::double else s.words * f.weight / s.weight end as target
  from filled f cross join level l left join open_share s on true),
plan as (
  select *, floor(target + 0.5)::bigint as budget,
    case when source_size > 0 then floor(target + 0.5)::bigint // source_size else 0 end as epochs
  from targets),
keyed as (
  select r.doc_id, r.size, p.source_size, p.target, p.epochs, p.budget - p.epochs * p.source_size as rest,
    count(*) over (partition by r.source, r.key) as n,
    coalesce(sum(r.size) over (partition by r.source order by r.key
      range between unbounded preceding and 1 preceding), 0) as before
  from rows r join plan p on r.source is not distinct from p.source)
select doc_id, size, source_size, target,
  (epochs * size + case when rest - before <= 0 then 0 when rest - before >= n * size then size
    else (rest - before) // n end)::bigint as taken
from keyed
"""
