"""The registered queries of the subpackage, one per operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fairlend.llm.bpe import bpe_digests
from fairlend.llm.embedding_dedup import ORACLE as NEAR_SQL, near_duplicates
from fairlend.llm.jaccard_join import ORACLE as JACCARD_SQL, jaccard_groups
from fairlend.llm.lm_scoring import scoring_report
from fairlend.llm.merkle import ORACLE as MANIFEST_SQL, manifest_report
from fairlend.llm.quality import resample
from fairlend.llm.source_mixing import ORACLE as MIX_SQL, mix
from fairlend.llm.substring_dedup import ORACLE as SUBSTRING_SQL, substring_report
from fairlend.llm.suffix_dedup import suffix_report
from fairlend.llm.token_store import token_file_report
from fairlend.llm.toxicity import toxicity_report
from fairlend.llm.topk_search import ORACLE as TOP_SQL, top_k
from fairlend.llm.whitening import whitening_report


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows of embeddings for each row whose vec_id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return top_k(rows.where("vec_id % 50 = 0"), rows, k=5)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents mixed to source weights 5, 2, 1, at most three epochs of a source."""
    return mix(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 35-word windows that repeat anywhere."""
    return substring_report(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled documents that are not held out."""
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights of every document towards labelled quality text, and the Gumbel top-k sample."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.93 and their components among embeddings of equal label."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
    return near_duplicates(rows, least=0.93)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents grouped by links of 85 percent Jaccard similarity of 4-word shingles."""
    return jaccard_groups(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and their decoding, as digests."""
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 400-byte strings that repeat anywhere."""
    return suffix_report(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document with the end id 2, written as Huffman-coded blocks and read back."""
    return token_file_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether the proof holds after tampering."""
    return manifest_report(table(spark, sf_dir, "documents"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document by counts and by a class bigram model of those not held out."""
    return scoring_report(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector of embeddings along the first 8 components of all of them."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return whitening_report(rows, most=8)


QUERIES = {
    "op1_topk_search": op1_topk_search,
    "op2_source_mixing": op2_source_mixing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_quality_resampling": op5_quality_resampling,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_token_files": op10_token_files,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_lm_scoring": op12_lm_scoring,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLE: dict[str, str] = {
    "op1_topk_search": TOP_SQL,
    "op2_source_mixing": MIX_SQL,
    "op3_substring_dedup": SUBSTRING_SQL,
    "op6_embedding_dedup": NEAR_SQL,
    "op7_jaccard_join": JACCARD_SQL,
    "op11_merkle_manifest": MANIFEST_SQL,
}
