"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Toxic documents go, then those whose language can't be told; of each class of
near copies one stays; personal data is replaced; what is left is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm import langid, packing, pii, toxicity
from furlong.llm._shared import stored
from furlong.llm.near_copies import one_of_each_class
from furlong.llm.queries import SURROGATE_KEY, language_model, toxicity_model

#: A document whose best language has less than this share of its words is rejected; with four languages, chance would give 0.25.
LEAST_LANGUAGE_SHARE = 0.4


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: rejects documents predicted toxic, by a model of the labelled documents outside the held-out fold."""
    return toxicity.with_toxicity(docs, toxicity_model(spark, sf_dir)).filter("predicted = 0").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: rejects documents without a language, or whose best language has too small a share of the words."""
    found = langid.with_languages(docs, language_model(spark, sf_dir))
    return found.filter(F.col("lang_pred") != langid.UNKNOWN).filter(F.col("score") >= LEAST_LANGUAGE_SHARE).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: keeps the document of the smallest id of each class; of repeated rows of that id one stays."""
    return one_of_each_class(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: replaces personal data by surrogates; n_chars follows the text."""
    return pii.replace_entities(docs, SURROGATE_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: packs all that is left."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxic), ("language ID", language), ("n-gram Jaccard join", near_copies), ("PII", personal_data), ("best-fit packing", packed)]

#: The learned stages have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
