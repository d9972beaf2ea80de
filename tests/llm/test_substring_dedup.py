import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import types as T

from fairlend.llm import repeats, substring_dedup
from fairlend.llm.substring_dedup import deep_leaves, substring_report, without_repeats

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("tag", T.StringType()), T.StructField("kept", T.StringType()),
                       T.StructField("n_chars", T.LongType())])


def brute(rows, window=35):
    docs = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    seen = Counter(tuple(w[k:k + window]) for _, w in docs for k in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k:k + window])] > 1:
                gone.update(range(k, k + window))
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


def made():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passage, line, base = text(80), text(36), text(150)
    rows = []
    for i in range(150):
        w = text(rng.randint(0, 160))
        if i % 3 == 0:
            k = rng.randrange(len(w) + 1)
            w[k:k] = passage
        if i % 5 == 0:
            w += line[:rng.randint(30, 36)] + text(5)
        rows.append((i, " ".join(w)))
    for i in range(60):  # near copies
        w = list(base)
        w[rng.randrange(150)] = "edit"
        rows.append((1000 + i, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(2000 + i, " ".join(base)) for i in range(25)]
    rows += [(3000, None), (3001, ""), (3002, "a " * 500), (3003, "ab cd " * 300), (3004, "x"), (None, " ".join(base)),
             (0, " ".join(passage)), (2000, " ".join(base)), (3005, " ".join(text(30_000))), (None, "é " * 20)]
    return rows


@pytest.mark.parametrize("wide,pack,held", [(4096, 1 << 20, 400_000), (3, 2_000, 50), (1, 1, 1)])
def test_equals_brute_force(spark, monkeypatch, wide, pack, held):
    monkeypatch.setattr(substring_dedup, "WIDE", wide)
    monkeypatch.setattr(repeats, "PACK_BYTES", pack)
    monkeypatch.setattr(repeats, "HELD", held)
    rows = made()
    df = spark.createDataFrame([(i, t, "x", "y", None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in substring_report(df).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    if wide > 3:
        kept = {r.doc_id: r for r in without_repeats(df).collect()}
        assert kept[3005].text == dict(rows)[3005] and kept[2003].text == "" and kept[2003].tag == "x"
        assert kept[3000].text is None and without_repeats(df).columns == df.columns
        assert all(r.text is None or r.n_chars == len(r.text) for r in kept.values())


def test_empty_table(spark):
    assert substring_report(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=14), max_size=6), st.integers(1, 5))
def test_leaves_below_deep_nodes(texts, window):
    import numpy as np

    got = set()
    for i, s, n in deep_leaves([np.array(t, np.uint64).tobytes() for t in texts], [False] * len(texts), window):
        got |= {(i, k) for k in range(s, s + n)}
    seen = Counter(tuple(t[k:k + window]) for t in texts for k in range(len(t) - window + 1))
    assert got == {(i, k) for i, t in enumerate(texts) for k in range(len(t) - window + 1)
                   if seen[tuple(t[k:k + window])] > 1}


def test_no_task_gathers_a_hot_key(spark, monkeypatch):
    """Exact copies in many tasks, and a gram that is the anchor in many contexts."""
    monkeypatch.setattr(substring_dedup, "WIDE", 8)
    monkeypatch.setattr(repeats, "HELD", 20)
    rng = random.Random(9)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    copy, gram = text(60), text(8)
    rows = [(i, " ".join(copy)) for i in range(120)]
    rows += [(500 + i, " ".join(text(34) + gram + text(34))) for i in range(120)]
    rows += [(800 + i, " ".join(text(20) + copy[5:45] + text(20))) for i in range(60)]
    widest, meet = [0], repeats._meet

    def watched(df, *args, **kw):
        widest.extend(r["count"] for r in df.groupBy("key").count().collect())
        return meet(df, *args, **kw)
    monkeypatch.setattr(repeats, "_meet", watched)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    got = [tuple(r) for r in substring_report(df).collect()]
    assert sorted(got) == sorted(brute(rows)) and max(widest) <= 8
