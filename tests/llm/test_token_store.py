import heapq
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import types as T
from tokenizers import Tokenizer

from fairlend.llm.huffman import Code, code_lengths
from fairlend.llm import token_store
from fairlend.llm.token_store import HubEncoder, token_file_report

PATH = public_tokenizers.path("byte_bpe_50k.json")


def unlimited_cost(counts):
    heap, cost = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 200), min_size=2, max_size=80))
def test_lengths_are_optimal_where_the_limit_does_not_bind(counts):
    counts = np.array(counts)
    if (counts > 0).sum() < 2:
        return
    lengths = code_lengths(counts)
    assert int((lengths * counts).sum()) == unlimited_cost(counts)
    assert sum(2.0 ** -int(x) for x in lengths if x) == pytest.approx(1)


def test_the_limit_holds_for_steep_counts():
    lengths = code_lengths(np.array([2 ** i for i in range(60)]), 8)
    assert lengths.max() == 8 and sum(2.0 ** -int(x) for x in lengths) <= 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=400), st.integers(1, 60))
def test_code_round_trip(ids, block):
    ids = np.array(ids, np.int64)
    code = Code(code_lengths(np.bincount(ids, minlength=41)))
    payload, marks = code.encode(ids, block)
    assert len(marks) == -(-len(ids) // block)
    assert code.decode(payload, marks, len(ids), block).tolist() == ids.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab'stre  \n1é漢!"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_ids_are_the_librarys(texts):
    texts = [*texts, "a <|endoftext|> b", " one two three", ""]
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, ENCODER.code).tolist() for x in ENCODER(texts)] == want


ENCODER = HubEncoder(PATH)
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("tie", T.StringType()), T.StructField("ids", T.StringType())])


def test_report_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT", 700)
    texts = [None, "", "one word", "the and " * 900, "éa漢 " * 40, "same", "same", "z"] + [f"text {i} " * i for i in range(60)]
    rows = [(7 if t == "same" else None if t == "z" else 1000 - i, t, "x", "y") for i, t in enumerate(texts)]
    got = token_file_report(spark.createDataFrame(rows, SCHEMA).repartition(5), PATH).collect()
    tokenizer, start, want = Tokenizer.from_file(PATH), 0, []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_empty_table(spark):
    assert token_file_report(spark.createDataFrame([], SCHEMA), PATH).count() == 0
