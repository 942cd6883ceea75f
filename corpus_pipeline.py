"""A training-corpus pipeline over documents: each stage is one operator of bookweave.llm.

Every stage takes rows with the columns of documents, with nulls in any of them, repeated rows
and more columns, and returns all columns it is given; an empty table gives an empty one. The
key of the pseudonyms is read from the session's spark.bookweave.pseudonymKey; without it the
example key of the registered queries is used, which hides nothing from who has this source.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookweave.llm import bpe, decontam, langid, pii, simhash
from bookweave.llm.queries import VOCABULARY, pseudonym_key, small_batches
from bookweave.plans.scratch import stage_table

#: Least share of a document's character n-grams that must be common in the learned languages:
#: texts in these have 0.97 and more on the given tables, other scripts 0.46 and less.
LEAST_FAMILIAR = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; texts that are null, have no letter or are in no learned language go. Repeated rows go or stay together.

    The score weighs the learned languages against each other; that a text is in one of them
    is told by its n-grams, most of which must be common there.
    """
    small_batches(spark)
    model = langid.train(docs.where(~langid.held_out()))
    told = langid.predict(docs, model)
    return told.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("familiar") >= LEAST_FAMILIAR)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingle sets are 0.8 alike or more: that of the smallest doc_id, of repeated rows one.

    Null and empty texts are equal texts, so one of them stays; rows without a doc_id stay.
    """
    small_batches(spark)
    return simhash.keep_one(docs, 5, 0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none and stay, as repeated rows do. An empty benchmark keeps all."""
    small_batches(spark)
    marked = decontam.mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where(F.size("leaks") == 0).select(*docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data under pseudonyms and n_chars set anew; null texts stay null, equal texts stay equal."""
    small_batches(spark)
    out = pii.pseudonymise(docs, pseudonym_key(spark))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids, and whether these decode to the text's bytes; null and empty texts have no ids.

    The ids are written before they are decoded, so that a task never holds two Python workers.
    """
    small_batches(spark)
    path = public_tokenizers.path(VOCABULARY)
    coded = stage_table(bpe.encode(docs, path, public_tokenizers.PATTERN), "ids")
    out = bpe.decode(coded, path, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return out.select(*docs.columns, "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("intact"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pseudonyms", pseudonyms),
    ("tokens", tokens),
]

#: No stage but the decontamination and the pseudonyms could be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage_table(docs, name)
    return docs
