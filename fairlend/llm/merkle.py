"""Operator 11: a Merkle manifest of a dataset.

Every row is a leaf.  Per group, leaves ascend by key; runs of three consecutive
nodes become one node until one is left, the group's subroot, and the subroots
give the root in the same way.

A row's place in its group comes from a range partitioning: its number inside
its range after the sizes of the ranges before.  The place's base-3 digits are
the columns of a rollup: blocks of ``3 ** LEVELS`` places are dealt to tasks
once, and inside a block grouping after grouping takes the lowest digit away,
hashes the nodes it held and nests them as an array of structs.  The blocks'
nodes are the next tier's places.  On the way back, ``transform`` unfolds a
block's nested structs from the top, each child with its siblings' digests,
and ``explode`` gives a row per leaf.  What a block's own proof needs from the
tiers above reaches it in one grouping by the block's number; nothing is joined.

Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fairlend.llm.tables import stored

#: Nodes that become one.
ARITY = 3
#: Digits of a block; it holds ``ARITY ** LEVELS`` leaves, which bounds a row of nested structs.
LEVELS = 7
BLOCK = ARITY ** LEVELS


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Hex sha256 of the fields, each as its UTF-8 byte count, ``:`` and value, and ``-`` where null."""
    parts = []
    for f in fields:
        text = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _digests(nodes: Column) -> Column:
    return F.concat_ws("", F.transform(nodes, lambda x: x["digest"]))


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0, by ``order``, nulls first) and ``n``, the rows of their group.

    Rows equal in group and order are dealt by a seeded random number, so that
    many of them need not meet in one task; which of them comes first is the
    same for every purpose.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    salted = rows.withColumn("_salt", F.rand(7))
    ranged = stored(salted.repartitionByRange(width, *keys, F.col("_salt")).withColumn("_part", F.spark_partition_id()),
                    "merkle-ranges")
    # One row per range and group that meet: ranges of many groups aside, a group has a row per range.
    sizes = ranged.groupBy(*group, "_part").agg(F.count("*").alias("_in"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored(sizes.select(*(F.col(c).alias(f"_g_{c}") for c in group), F.col("_part").alias("_p"),
                                F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_before"),
                                F.sum("_in").over(whole).alias("n")), "merkle-sizes")
    same = F.col("_part") == F.col("_p")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    place = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*keys[len(group):], "_salt"))
    return (ranged.withColumn("_place", place).join(sizes, same)
            .select(*rows.columns, (F.col("_before") + F.col("_place") - 1).alias("rank"), "n"))


def rolled(nodes: DataFrame, group: Sequence[str], name: str) -> DataFrame:
    """(group, block, n, node): one row per block of ``nodes`` (group, rank, n, node with a digest).

    ``node`` holds the digest, whether its children became one by hashing
    (``many``), and the children in order, nested ``LEVELS`` deep; a group
    with one node left passes it on as it is.
    """
    digit = [f"_d{k}" for k in range(LEVELS)]
    rows = nodes.select(*group, "n", F.expr(f"rank div {BLOCK}").alias("block"), "node",
                        *(F.expr(f"cast((rank div {ARITY ** k}) % {ARITY} as byte)").alias(d) for k, d in enumerate(digit)))
    rows = rows.repartition(*group, "block")
    for k, d in enumerate(digit):
        held = rows.groupBy(*group, "n", "block", *digit[k + 1:]).agg(
            F.array_sort(F.collect_list(F.struct(F.col(d).alias("place"), "node"))).alias("kids"))
        held = held.withColumns({"kids": F.transform("kids", lambda x: x["node"]), "many": F.col("n") > ARITY ** k})
        one = F.when(F.col("many"), F.sha2(_digests(F.col("kids")), 256)).otherwise(F.col("kids")[0]["digest"])
        rows = held.select(*group, "n", "block", *digit[k + 1:],
                           F.struct(one.alias("digest"), "many", "kids").alias("node"))
    return stored(rows, name)


def tiers_of(nodes: DataFrame, group: Sequence[str], name: str) -> list[DataFrame]:
    """Blocks of ``nodes``, blocks of those blocks' nodes, and so on until every group has one block."""
    tiers = [rolled(nodes, group, f"{name}-0")]
    while (tiers[-1].agg(F.max("n")).first()[0] or 0) > BLOCK:
        above = tiers[-1].select(*group, F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("block").alias("rank"),
                                 F.struct(F.col("node.digest").alias("digest"), F.col("block").alias("below")).alias("node"))
        tiers.append(rolled(above, group, f"{name}-{len(tiers)}"))
    return tiers


_PATH = "array<struct<left:string,right:string>>"


def unfolded(tier: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per leaf of each block: ``keep``, ``leaf`` and ``path``, its siblings' digests level by level.

    ``path`` goes from the leaf up and ends with the block's own path ``above``.
    """
    none = F.array().cast(_PATH)
    held = F.array(F.struct(F.col("node").alias("node"), none.alias("path")))
    for _ in range(LEVELS):
        def children(parent: Column) -> Column:
            kids = parent["node"]["kids"]

            def child(kid: Column, place: Column) -> Column:
                step = F.struct(_digests(F.slice(kids, F.lit(1), place)).alias("left"),
                                _digests(F.slice(kids, place + 2, F.lit(ARITY))).alias("right"))
                return F.struct(kid.alias("node"), F.concat(F.when(parent["node"]["many"], F.array(step)).otherwise(none),
                                                            parent["path"]).alias("path"))
            return F.transform(kids, child)
        held = F.flatten(F.transform(held, children))
    one = tier.select(*keep, "above", F.explode(held).alias("one"))
    return one.select(*keep, F.col("one.node").alias("leaf"), F.concat("one.path", "above").alias("path"))


def handed_down(tier: DataFrame, above: DataFrame, keys: Sequence[str], what: Sequence[str]) -> DataFrame:
    """The rows of ``tier`` with the columns ``what`` of the row of ``above`` under the same keys.

    One row of each side per key: they meet in a grouping, where nulls are equal.
    """
    both = tier.select(*keys, "node").unionByName(above.select(*keys, *what), allowMissingColumns=True)
    return both.groupBy(*keys).agg(*(F.first(c, ignorenulls=True).alias(c) for c in ["node", *what]))


def _down(tiers: list[DataFrame], top: DataFrame, group: Sequence[str], what: Sequence[str], ) -> DataFrame:
    """Leaves of the lowest tier with their paths; ``top``: (group, block, above and the rest of ``what``)."""
    keys, rest = [*group, "block"], [c for c in what if c != "above"]
    for tier in reversed(tiers[1:]):
        rows = unfolded(handed_down(tier, top, keys, what), [*group, *rest])
        top = rows.select(*group, F.col("leaf.below").alias("block"), F.col("path").alias("above"), *rest)
    return unfolded(handed_down(tiers[0], top, keys, what), [*group, *rest])


def manifest(rows: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(group, key, leaf, carry..., subroot, root, path) for each of ``rows`` (group, key, leaf, carry...).

    ``path`` is the proof: for each run of nodes from the leaf to the root, the
    digests left and right of the leaf's own node.  Rows with equal keys ascend
    by leaf; null groups are one group, the first; a null key comes first.  An
    empty table gives no rows.
    """
    leaves = stored(rows.select("group", "key", "leaf", *carry), "merkle-leaves")
    node = F.struct(F.col("leaf").alias("digest"), "key", *carry)
    places = ranked(leaves, ["group"], ["key", "leaf"])
    below = tiers_of(places.select("group", "rank", "n", node.alias("node")), ["group"], "merkle-rows")
    roots = below[-1].select("group", F.col("node.digest").alias("subroot"))
    groups = ranked(roots, [], ["group"])
    node = F.struct(F.col("subroot").alias("digest"), F.col("group").alias("of"))
    above = tiers_of(groups.select("rank", "n", node.alias("node")), [], "merkle-groups")
    empty = F.array().cast(_PATH)
    top = above[-1].select("block", empty.alias("above"), F.col("node.digest").alias("root"))
    tops = stored(_down(above, top, [], ["above", "root"]), "merkle-tops")
    starts = tops.select(F.col("leaf.of").alias("group"), F.lit(0).cast("long").alias("block"),
                         F.col("path").alias("above"), F.col("leaf.digest").alias("subroot"), "root")
    out = _down(below, starts, ["group"], ["above", "subroot", "root"])
    return out.select("group", "leaf.key", F.col("leaf.digest").alias("leaf"),
                      *(F.col("leaf")[c].alias(c) for c in carry), "subroot", "root", "path")


def proof_digest(path: Column) -> Column:
    """Hex sha256 of all digests of a proof, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda p: F.concat(p["left"], p["right"]))), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` gives under the proof ``path``."""
    return F.aggregate(path, leaf, lambda digest, p: F.sha2(F.concat(p["left"], digest, p["right"]), 256))


def manifest_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of ``docs``.

    Rows under an id whose decimal digits have an even crc32 are tampered with:
    their text loses its line feeds (a null text stays), and the proof is folded
    from the leaf so made.  A null doc_id is not tampered with; equal ids ascend
    by leaf; a null source is the first source; null, empty and long texts are
    hashed as they are.  An empty table gives no rows; columns beside doc_id,
    source, lang, n_chars and text are ignored.
    """
    def digest(text: Column) -> Column:
        return leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])

    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    less = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    rows = docs.select(F.col("source").alias("group"), F.col("doc_id").alias("key"), digest(F.col("text")).alias("leaf"),
                       F.when(even & F.contains("text", F.lit("\n")), digest(less)).alias("altered"))
    out = manifest(rows, ["altered"]).withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("path")))
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root",
                      proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::varchar)::varchar || ':' || {value}::varchar, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: The lowest bit of the crc32 of doc_id's digits: one step of the shift register per bit, lowest first.
_ODD_SQL = """xor(list_reduce(list_prepend(4294967295::bigint, flatten([
      [(ascii(c) >> b) & 1 for b in range(8)] for c in string_split(doc_id::varchar, '')])),
      lambda r, b: xor(r >> 1, (xor(r, b) & 1) * 3988292384)), 4294967295) & 1"""

#: DuckDB SQL for ``manifest_report`` over the table documents.
ORACLE = f"""
with recursive leaves as materialized (
  select doc_id, source, leaf, coalesce(altered, leaf) as start,
    row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place,
    row_number() over (order by source nulls first, doc_id nulls first, leaf) as id
  from (select *, {_leaf_sql('text')} as leaf,
          case when {_ODD_SQL} = 0 then {_leaf_sql("replace(text, chr(10), '')")} end as altered
        from documents)),
tree as (
  select source, 0 as level, place as pos, leaf as digest, count(*) over (partition by source) as n from leaves
  union all
  select source, level + 1, pos // 3, sha256(string_agg(digest, '' order by pos)), (max(n) + 2) // 3
  from tree where n > 1 group by source, level, pos // 3),
subs as materialized (
  select source, digest as subroot, row_number() over (order by source nulls first) - 1 as place from tree where n = 1),
top as (
  select 0 as level, place as pos, subroot as digest, count(*) over () as n from subs
  union all
  select level + 1, pos // 3, sha256(string_agg(digest, '' order by pos)), (max(n) + 2) // 3
  from top where n > 1 group by level, pos // 3),
steps as materialized (
  select id, 0 as part, level,
    coalesce(string_agg(digest, '' order by pos) filter (pos < place // (3 ** level)::bigint), '') as before,
    coalesce(string_agg(digest, '' order by pos) filter (pos > place // (3 ** level)::bigint), '') as after
  from leaves l join tree t on l.source is not distinct from t.source and n > 1
    and pos // 3 = place // (3 ** (level + 1))::bigint
  group by id, level
  union all
  select id, 1, level,
    coalesce(string_agg(digest, '' order by pos) filter (pos < s.place // (3 ** level)::bigint), ''),
    coalesce(string_agg(digest, '' order by pos) filter (pos > s.place // (3 ** level)::bigint), '')
  from leaves l join subs s on l.source is not distinct from s.source
    join top t on n > 1 and pos // 3 = s.place // (3 ** (level + 1))::bigint
  group by id, level),
numbered as materialized (
  select *, row_number() over (partition by id order by part, level) as k,
    count(*) over (partition by id) as steps from steps),
folds as (
  select id, 0 as k, start as digest from leaves
  union all
  select f.id, f.k + 1, sha256(before || digest || after)
  from folds f join numbered s on f.id = s.id and s.k = f.k + 1),
proofs as (select id, string_agg(before || after, '' order by k) as proof, max(k) as steps from numbered group by id)
select l.doc_id, l.leaf, s.subroot, r.digest as root, sha256(coalesce(p.proof, '')) as proof_sha256,
  f.digest as folded_root, f.digest = r.digest as verified
from leaves l join subs s on l.source is not distinct from s.source
  join (select digest from top where n = 1) r on true
  left join proofs p on l.id = p.id
  join folds f on l.id = f.id and f.k = coalesce(p.steps, 0)
"""
