import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import types as T

from fairlend.llm import repeats, suffix_dedup
from fairlend.llm.suffix_array import common_prefixes, suffix_order
from fairlend.llm.suffix_dedup import shared_suffixes, suffix_report

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("kept", T.StringType()), T.StructField("seg", T.StringType())])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.integers(1, 4))
def test_suffix_order_and_common_prefixes(symbols, most):
    text = [min(s, most) for s in symbols] + [0]
    order = suffix_order(np.array(text, np.int64))
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    length, _ = common_prefixes(np.array(text), order, np.arange(len(text))[::-1].copy())
    for i, j in zip(order[1:].tolist(), order[:-1].tolist()):
        k = 0
        while max(i, j) + k < len(text) - 1 and text[i + k] == text[j + k]:
            k += 1
        assert length[i] == k


def test_long_runs_and_periods():
    for raw in (b"a" * 3000, b"ab" * 2000, b"abcab" * 700 + b"x", bytes(range(256)) * 12):
        text = np.append(np.frombuffer(raw, np.uint8).astype(np.int16) + 1, 0)
        values = text.tolist()
        assert suffix_order(text).tolist() == sorted(range(len(values)), key=lambda i: values[i:i + 2100] + [-1])\
            or suffix_order(text).tolist() == sorted(range(len(values)), key=lambda i: values[i:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=12).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6), st.integers(1, 5))
def test_shared_suffixes(texts, window):
    got = {(i, k) for i, s, n in shared_suffixes(texts, [False] * len(texts), window) for k in range(s, s + n)}
    seen = Counter(t[k:k + window] for t in texts for k in range(len(t) - window + 1))
    assert got == {(i, k) for i, t in enumerate(texts) for k in range(len(t) - window + 1) if seen[t[k:k + window]] > 1}


def brute(rows, window=400):
    docs = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k:k + window] for _, b in docs for k in range(len(b) - window + 1))
    out = []
    for i, b in docs:
        gone = np.zeros(len(b) + 1, np.int64)
        for k in range(len(b) - window + 1):
            if seen[b[k:k + window]] > 1:
                gone[k] += 1
                gone[k + window] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()),
                    hashlib.sha256(left).hexdigest()))
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


def made():
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    passage, base = text(700), text(1500)
    rows = []
    for i in range(60):
        t = text(rng.randint(0, 900))
        if i % 3 == 0:
            k = rng.randrange(len(t) + 1)
            t = t[:k] + passage[:rng.randint(380, 700)] + t[k:]
        rows.append((i, t))
    for i in range(25):
        k = rng.randrange(1400)
        rows.append((1000 + i, base[:k] + "#" + base[k + 1:]))
    rows += [(2000 + i, base) for i in range(10)]
    rows += [(3000, None), (3001, ""), (3002, "z" * 3000), (3003, "xyz" * 500), (None, base), (0, passage),
             (3004, "q" * 399), (3005, "q" * 400), (3006, text(60_000)), (2000, base)]
    return rows


@pytest.mark.parametrize("wide,pack,held", [(2048, 1 << 20, 400_000), (2, 3_000, 40)])
def test_equals_brute_force(spark, monkeypatch, wide, pack, held):
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    monkeypatch.setattr(repeats, "PACK_BYTES", pack)
    monkeypatch.setattr(repeats, "HELD", held)
    rows = made()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in suffix_report(df).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_empty_table(spark):
    assert suffix_report(spark.createDataFrame([], SCHEMA)).count() == 0
