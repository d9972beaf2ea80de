import public_tokenizers
import pyarrow as pa

from fairlend.llm import text
from fairlend.llm.bpe import bpe_digests, load_ranks
from fairlend.llm.jaccard_join import shingle_sets
from fairlend.llm.substring_dedup import word_units

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_a_worker_remembers_what_one_operator_needs():
    load_ranks(RANKS)
    texts = pa.array(["a b c d e", None, "b"])
    first = shingle_sets(texts)
    assert {k[0] for k in text._KEPT} == {"jaccard"}
    word_units(texts)
    assert {k[0] for k in text._KEPT} == {"substring"}
    again = shingle_sets(texts)
    assert all((a == b).all() for a, b in zip(first, again)) and {k[0] for k in text._KEPT} == {"jaccard"}


def test_encoding_and_decoding_need_one_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = bpe_digests(docs, RANKS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
