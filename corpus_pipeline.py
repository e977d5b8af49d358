"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Every stage works on all rows that the one before it kept, and all but the last return the columns of
documents. Toxic documents go, then exact copies, then all but one document of each near-duplicate
group; what is left is drawn to the target mix of sources, languages and topics, lifted rows several times,
and encoded.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from presentia.llm import toxicity
from presentia.llm.bpe import bpe_round_trip
from presentia.llm.exact_dedup import drop_copies
from presentia.llm.minhash import drop_near_copies
from presentia.llm.mixing import repeat_mix
from presentia.plans.materialize import materialize


# Each stage keeps the user's columns as they are, whatever their names, and gives an empty table for an empty one.


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; the model learns from the labelled rows outside the held-out fold.

    Null and empty texts and rows without id are clean; very long texts are read whole; repeated rows stay or go
    together. Without labels of both classes nothing is dropped.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the smallest id, then the first of repeated rows.

    Null, empty and blank texts are one group; very long texts are compared whole; a null id is the largest.
    """
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8): the smallest id.

    Null and empty texts are groups of their own; very long texts are compared whole; rows that repeat an id stay
    or go together; a row without id stays only where its group has no id.
    """
    return drop_near_copies(docs, size=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the target weights of sources, languages and topics; rows of lifted cells are repeated.

    Null sources and languages are values like others; cells of null and empty texts have no tokens to weigh and
    are not drawn; repeated rows are drawn alike; the id alone decides between the documents of a cell.
    """
    return repeat_mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row that is left.

    Null and empty texts have no tokens; very long texts are encoded whole; repeated rows give repeated results.
    """
    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean),
    ("exact dedup", exact),
    ("minhash near-dedup", near),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: A trained model and the tokenizer are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
