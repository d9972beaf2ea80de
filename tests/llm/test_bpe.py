import hashlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import types as T

from fairlend.llm.bpe import RankQueue, bpe_digests, decode_bpe, encode_bpe, encode_piece, load_ranks
from fairlend.llm.pretokens import piece_keys, piece_text, pieces

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
QUEUE = RankQueue(60_000)
PATTERN = regex.compile(public_tokenizers.PATTERN)


@lru_cache
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(PATH),
                             special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab sSt'relvmd  \n\t  1٣é!?-"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_pieces_are_the_matches_of_the_pattern(text):
    assert pieces(text) == PATTERN.findall(text)
    assert [piece_text(k) for k in piece_keys(text)] == pieces(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=255), max_size=60))
def test_latin_pieces(text):
    assert [piece_text(k) for k in piece_keys(text)] == PATTERN.findall(text)


def test_every_character_class_is_the_patterns():
    text = "".join(f"{chr(c)}a" for c in range(0x3100) if not 0xD800 <= c < 0xE000)
    assert pieces(text) == PATTERN.findall(text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcde aaa'sxyzéö漢", max_size=80))
def test_ids_are_the_librarys(text):
    ranks, queue = load_ranks(PATH), QUEUE
    assert [i for p in pieces(text) for i in encode_piece(p.encode(), ranks, queue)] == library().encode_ordinary(text)


def test_long_pieces():
    ranks, queue = load_ranks(PATH), QUEUE
    for text in ("a" * 30_000, "ab" * 9_000, "thequickbrownfox" * 2_000, "=" * 5_001):
        assert encode_piece(text.encode(), ranks, queue) == library().encode_ordinary(text)


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("ids", T.StringType()), T.StructField("n_tokens", T.StringType())])


def test_rows_nulls_repeats_and_clashing_names(spark):
    texts = [None, "", "x", "Hello, it's 42\n\n  there" * 50, "<|endoftext|>", "é漢字 " * 30_000, "same", "same"]
    rows = [(i if i != 3 else None, t, "old", "old") for i, t in enumerate(texts)] + [(6, "same", "old", "old")]
    got = bpe_digests(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH).collect()
    want = []
    for doc_id, text, *_ in rows:
        ids = library().encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert [f.dataType.simpleString() for f in bpe_digests(spark.createDataFrame(rows, SCHEMA), PATH).schema] == \
        ["bigint", "bigint", "string", "string"]


def test_round_trip_keeps_other_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", "old", "1")], SCHEMA)
    row = decode_bpe(encode_bpe(df, PATH), PATH).first()
    assert bytes(row.decoded) == b"a b" and row.n_tokens == "1" and row.text == "a b"
    assert bpe_digests(df.limit(0), PATH).count() == 0
