"""A training corpus from ``documents``: toxic documents go, of each group of near copies one stays,
repeated passages are cut, sources are mixed to target weights, and the mix is encoded.

``STAGES`` lists the stages in order.  Each function takes (spark, docs,
sf_dir), works on all rows of ``docs`` and returns a DataFrame; all but the
last return the columns of documents.  ``run`` writes each stage's rows as
Parquet to the folder that the cluster shares and reads them again for the
next.  An empty table passes through every stage; nulls, empty and very long
texts and repeated rows are handled as each operator's docstring says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fairlend.llm.bpe import bpe_digests
from fairlend.llm.jaccard_join import one_of_each_group
from fairlend.llm.source_mixing import mixed_documents
from fairlend.llm.substring_dedup import without_repeats
from fairlend.llm.tables import scratch
from fairlend.llm.toxicity import learn_toxicity, score_toxicity
from fairlend.plans.session import shared_dir
from fairlend.sources.store import delete

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half, by a model of the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = docs.select(*COLUMNS)
    return score_toxicity(docs, learn_toxicity(docs, labels), "_toxicity").where("_toxicity < 0.5").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id.

    Rows are told apart by id and text, so a repeated id takes no other text
    with it; documents without words, and without an id, are in no group and
    stay.
    """
    return one_of_each_group(docs.select(*COLUMNS))


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 35-word windows that repeat anywhere; texts that lose nothing stay as they are."""
    return without_repeats(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to source weights 5, 2, 1 takes them, three times at most."""
    return mixed_documents(docs.select(*COLUMNS))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of the mix."""
    return bpe_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", clean),
    ("n-gram Jaccard join", one_of_each),
    ("substring dedup", without_passages),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding and decoding", encoded),
]

#: Learned scores and BPE have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents.  A stage's inner tables go once its result is written, and its input then, too."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        path = shared_dir(spark, f"pipeline-{k}")
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.schema(made.schema).parquet(path), path
    return docs
