import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import types as T

from fairlend.llm import source_mixing
from fairlend.llm.source_mixing import ORACLE, mix, mixed_documents

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())])
EXTRA = ["size", "taken", "key", "rest"]


def table(rows):
    return [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]


def targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while True:
        left, w = total - sum(full.values()), sum(weight[s] for s in names if s not in full)
        got = {s: left * weight[s] / w for s in names if s not in full}
        above = [s for s in got if got[s] > 3 * sizes[s]]
        if not above:
            return full | got
        full |= {s: 3 * sizes[s] for s in above}


def rows_of():
    rows = [(i, "w " * (i % 7) + "x\tyz\n" * (i % 3), ["a", "b", "c", None][min(i % 11, 3)]) for i in range(300)]
    rows += [(1000, None, "d"), (1001, "", "d"), (1002, " \t ", "e"), (None, "no id here", "a"), (5, "again", "b")]
    return rows + [(2007, "same row", "tiny")] * 3 + [(2008, "word " * 500, "f")]


@pytest.mark.parametrize("per_range", [3, 2_000])
def test_targets_budgets_and_limits(spark, monkeypatch, per_range):
    monkeypatch.setattr(source_mixing, "ROWS_PER_RANGE", per_range)
    rows = rows_of()
    df = spark.createDataFrame(table(rows), SCHEMA)
    for c in EXTRA:
        df = df.withColumn(c, df.text)
    got = mix(df).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    sizes = defaultdict(int)
    for i, t, s in rows:
        sizes[s] += size(t)
    want, taken = targets(sizes), defaultdict(int)
    of = {(i, size(t)): s for i, t, s in rows}
    for r in got:
        s = of[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 3 for s in want)
    assert sorted(map(str, mix(df.repartition(3)).collect())) == sorted(map(str, got))
    con = duckdb.connect()
    documents = df.select("doc_id", "text", "source").toArrow()  # noqa: F841
    assert Counter(con.sql(ORACLE).fetchall()) == Counter(map(tuple, got))
    texts = mixed_documents(df)
    assert texts.columns == df.columns
    words = defaultdict(int)
    for r in texts.collect():
        words[r.source] += size(r.text)
        assert r.n_chars == len(r.text)
    assert {s: n for s, n in taken.items() if n} == dict(words)


def test_empty_tables_and_no_words(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mix(none).count() == 0 and mixed_documents(none).count() == 0
    blank = spark.createDataFrame(table([(1, None, None), (2, " ", "a")]), SCHEMA)
    assert [tuple(r) for r in mix(blank).orderBy("doc_id").collect()] == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mixed_documents(blank).count() == 0


def test_no_python_on_the_path(spark):
    df = spark.createDataFrame(table([(1, "a b", "a"), (2, "c", "b")]), SCHEMA)
    plan = mix(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
