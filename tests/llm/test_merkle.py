"""Operator 11 against a plain recursion."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from fairlend.llm import merkle
from fairlend.llm.merkle import folded, leaf_digest, manifest, manifest_report

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, extra int, rank long, leaf string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(digests):
    """(root, proof of each digest as a list of (left, right))."""
    paths, own, nodes = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(nodes) > 1:
        for i, p in enumerate(own):
            a = p - p % 3
            paths[i].append(("".join(nodes[a:p]), "".join(nodes[p + 1:a + 3])))
        nodes, own = [H(*nodes[a:a + 3]) for a in range(0, len(nodes), 3)], [p // 3 for p in own]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], leaf_of(*r[:5]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    subs = {s: climb([x[1] for x in groups[s]]) for s in names}
    root, tops = climb([subs[s][0] for s in names]) if names else (None, [])
    out = []
    for s, top in zip(names, tops):
        for (doc_id, leaf, r), path in zip(groups[s], subs[s][1]):
            path, d = path + top, leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and r[4] is not None:
                d = leaf_of(*r[:4], r[4].replace("\n", ""))
            for left, right in path:
                d = H(left, d, right)
            out.append((doc_id, leaf, subs[s][0], root, H(*(a + b for a, b in path)), d, d == root))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def rows_of(n, sources):
    return [(i * 7 % n, sources[i % len(sources)], None if i % 5 == 0 else "en", i, f"line {i}\nnext é", 1, 2, "x")
            for i in range(n)]


@pytest.mark.parametrize("levels", [2, 7])
def test_equals_recursion(spark, monkeypatch, levels):
    """Several tiers of small blocks, and one block, give the same tree."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3 ** levels)
    rows = rows_of(190, ["a", "b", "a", "a", None, "a", "é", "Z"]) + [
        (1000, "one", None, None, None, 1, 2, "x"), (1001, "two", "", 0, "", 1, 2, "x"),
        (None, "a", "en", 3, "a\nb", 1, 2, "x"), (None, None, None, None, None, None, None, None),
        (5, "a", "en", 3, "same\n", 1, 2, "x"), (5, "a", "en", 3, "same\n", 1, 2, "x"),
        (2000, "two", "en", 9, "long " * 200_000 + "\n", 1, 2, "x")]
    got = manifest_report(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert result(got) == brute(rows)
    assert {r.verified for r in got.collect()} == {True, False}


def test_more_sources_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 3)
    rows = rows_of(40, [f"s{i}" for i in range(11)])
    assert result(manifest_report(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_one_row_and_none(spark):
    row = [(4, "a", "en", 3, "no line feed", 1, 2, "x")]
    got = manifest_report(spark.createDataFrame(row, SCHEMA)).first()
    assert got.leaf == got.subroot == got.root == got.folded_root and got.proof_sha256 == H("")
    assert manifest_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_third_of_the_rows_equal(spark):
    rows = rows_of(60, ["a", "b"]) + [(7, "a", "en", 1, "copy\n", 1, 2, "x")] * 30
    assert result(manifest_report(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_proof_fails_for_another_leaf(spark):
    rows = spark.range(50).select((F.col("id") % 2).cast("string").alias("group"), F.col("id").alias("key"),
                                  leaf_digest([F.col("id")]).alias("leaf"))
    out = manifest(rows)
    assert out.where(folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    assert out.where(folded(leaf_digest([F.col("key") + 1]), F.col("path")) == F.col("root")).count() == 0


def test_no_join_after_the_ranks(spark):
    """Proofs come from groupings and explode; the only joins give ranks."""
    rows = spark.range(50).select(F.lit("a").alias("group"), F.col("id").alias("key"), F.col("id").cast("string").alias("leaf"))
    plan = manifest(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan


def test_oracle(spark):
    rows = rows_of(200, ["a", "b", "a", None]) + [(3000, "z", None, None, None, 1, 2, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.register("frame", df.toPandas())
    con.execute("create view documents as select doc_id::bigint as doc_id, source, lang, "
                "n_chars::bigint as n_chars, text from frame")
    assert sorted(con.execute(merkle.ORACLE).fetchall(), key=str) == brute(rows)
