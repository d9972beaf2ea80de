import random

import pytest
from pyspark.sql import types as T

from fairlend.llm import jaccard_join
from fairlend.llm.jaccard_join import _among, _texts, _with_texts, jaccard_groups

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("tag", T.StringType()), T.StructField("n", T.StringType())])


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 4 else {tuple(w[k:k + 4]) for k in range(len(w) - 3)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    low = list(range(len(rows)))

    def root(x):
        while low[x] != x:
            x = low[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low[root(a)] = root(b)
    first = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            first[root(k)] = min(i, first.get(root(k), i))
    return [(i, len(sets[k]), first.get(root(k))) for k, (i, _) in enumerate(rows)]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def made(seed=1, vocabulary=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    line = text(12)
    rows, bases = [], [text(rng.randint(20, 120)) for _ in range(25)]
    for i in range(260):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            k = rng.randrange(len(w))
            if rng.random() < 0.5:
                w[k] = rng.choice(words)
            else:
                del w[k]
        if rng.random() < 0.3:
            w += line
        rows.append((i, " ".join(w).title() if i % 7 == 0 else "\n".join(w)))
    for n in (4, 5, 6, 7, 8, 9, 10, 11):  # small sets, whose overlaps are near the threshold
        w = text(n + 3)
        rows += [(500 + 10 * n + j, " ".join(w[:n + 3 - j])) for j in range(4)]
    rows += [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE"), (1004, "one two three"), (1005, " \t"),
             (None, " ".join(bases[0])), (None, "only here in a null row"), (3, rows[3][1]),
             (2000, " ".join(text(20_000))), (2001, "la " * 900), (2002, "la " * 901)]
    return rows


@pytest.mark.parametrize("rounds,chunk,wide,seed,vocabulary",
                         [(3, 256, 32, 1, 400), (1, 256, 2, 2, 400), (1, 2, 32, 3, 12), (1, 256, 4, 1, 400)])
def test_equals_brute_force(spark, monkeypatch, rounds, chunk, wide, seed, vocabulary):
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    monkeypatch.setattr(jaccard_join, "WIDE", wide)
    rows = made(seed, vocabulary)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(4)
    got = [tuple(r) for r in jaccard_groups(df).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_empty_table_and_no_links(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert jaccard_groups(none).columns == ["doc_id", "n_shingles", "component_id"] and jaccard_groups(none).count() == 0
    one = spark.createDataFrame([(4, "a b c d e f g", "", ""), (2, None, "", "")], SCHEMA)
    assert sorted(map(tuple, jaccard_groups(one).collect())) == [(2, 0, 2), (4, 4, 4)]


def test_a_large_family_below_the_threshold(spark, monkeypatch):
    """Rows that share many rare shingles and mostly do not link: they meet in tiles, and no pair of them is listed."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(180):
        w = list(base)
        for k in rng.sample(range(60), 3 if i % 3 else 1):
            w[k] = f"x{i}_{k}" if i % 5 else f"y{k}"
        rows.append((i, " ".join(w)))
    seen = []
    verified = jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda pairs, texts: seen.append(pairs.count()) or verified(pairs, texts))
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(4)
    got = [tuple(r) for r in jaccard_groups(df).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert seen[-1] <= jaccard_join.WIDE * len(rows) and len({c for _, _, c in got}) > 20


def test_many_equal_rows_without_an_id(spark, monkeypatch):
    """One row per set goes to the tiles, however many equal rows stand for it."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text)] * 60 + [(5, text)] * 40 + [(7, text + " more"), (None, "w " + text), (9, "quite another text here")]
    held, texts = [], jaccard_join._texts

    def counted(*args):
        out = texts(*args)
        held.append((out.count(), out.select("id").distinct().count()))
        return out

    monkeypatch.setattr(jaccard_join, "_texts", counted)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(4)
    got = [tuple(r) for r in jaccard_groups(df).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert held == [(3, 3)]


def test_one_of_each_group_tells_rows_apart_by_id_and_text(spark):
    near = " ".join(f"w{i}" for i in range(40))
    rows = [(1, near, "a", "y"), (2, near + " end", "b", "y"), (2, "another clean text under the id two", "c", "y"),
            (3, near, "d", "y"), (3, near, "e", "y"), (None, near, "f", "y"), (4, None, "g", "y"), (4, "", "h", "y"),
            (6, "rows that are equal in all", "i", "y"), (6, "rows that are equal in all", "i", "y"),
            (None, "only without an id here", "j", "y"), (None, "only without an id here", "j", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = jaccard_join.one_of_each_group(df)
    assert got.columns == df.columns
    assert sorted(r.tag for r in got.collect()) == ["a", "c", "f", "g", "h", "i", "j", "j"]


def test_texts_are_told_apart_before_an_exchange(spark):
    rows = [(k if k % 7 else None, k * 31) for k in range(3_000)]
    tagged = spark.createDataFrame([(*r, f"text {r[1]}") for r in rows], "doc_id long, tag long, text string")
    wanted = spark.createDataFrame(rows[::10], "r_id long, r_tag long")
    near = {tuple(r)[:2] for r in _among(tagged, wanted).collect()}
    rest = [tuple(r)[:2] for r in _among(tagged, wanted, others=True).collect()]
    assert set(rows[::10]) <= near and len(near) < 320
    assert len(rest) + len(near) == len(rows) and not near & set(rest)


def test_texts_of_repeated_rows_come_once(spark):
    tagged = spark.createDataFrame([(1, 5, "a"), (1, 5, "a"), (None, 6, "b"), (3, 7, "c")], "doc_id long, tag long, text string")
    known = spark.createDataFrame([(10, 1, 5), (11, None, 6), (12, 3, 7)], "id long, r_id long, r_tag long")
    members = spark.createDataFrame([(10, 0, 0, 0, 10), (10, 0, 0, 0, 11), (10, 0, 1, 0, 10)],
                                    "family long, i int, j int, spot int, id long")
    got = sorted((r.j, r.id, r.text) for r in _with_texts(members, _texts(tagged, tagged, known), tagged).collect())
    assert got == [(0, 10, "a"), (0, 11, "b"), (1, 10, "a")]
