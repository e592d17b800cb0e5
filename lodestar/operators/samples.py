"""Samples from the driver's tables: each document is a sample whose first sentence is the claim."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import CLAIM_COLUMNS, claim_words
from ..functions.text import once, sentences_of
from ..session import dealt


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def dealt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with all of a sample in one task from the start."""
    return dealt(documents(spark, sf_dir), "doc_id")


def segments(docs: DataFrame) -> DataFrame:
    """(sample_id, ord, sentence), no shuffle."""
    return docs.select(F.col("doc_id").alias("sample_id"), F.posexplode(sentences_of(F.col("text"))).alias("ord", "sentence")).withColumn("ord", F.col("ord").cast("long"))


def entities_of(claim) -> F.Column:
    """Capitalised words of four letters and more, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(claim, F.lit("[A-Z][a-z]{3,}"), F.lit(0)), F.lower))


def samples_of(docs: DataFrame) -> DataFrame:
    """(sample_id, claim, sentences) of documents; those without text are left out."""
    rows = docs.select(F.col("doc_id").alias("sample_id"), once(sentences_of(F.col("text"))).alias("all")).where(F.size("all") > 0)
    return rows.select("sample_id", F.get("all", F.lit(0)).alias("claim"), F.slice("all", 2, F.size("all")).alias("sentences"))


def sentences(samples: DataFrame, *more: str) -> DataFrame:
    """(sample_id, ord, sentence, claim, entities, ...) of samples(sample_id, claim, sentences, ...), ord from 1."""
    own = samples if "entities" in samples.columns else samples.withColumn("entities", entities_of(F.col("claim")))
    rows = own.select("sample_id", "claim", "entities", *more, F.posexplode("sentences").alias("ord", "sentence"))
    return rows.withColumn("ord", (F.col("ord") + 1).cast("long")).select("sample_id", "ord", "sentence", "claim", "entities", *more)


def candidates(docs: DataFrame, scored: bool = False) -> DataFrame:
    """(sample_id, ord, sentence, claim, entities) of all sentences but the claims. scored: with what scores need of the claim,
    worked out once for each document."""
    own = samples_of(docs).withColumn("entities", entities_of(F.col("claim")))
    return sentences(claim_words(own), *CLAIM_COLUMNS) if scored else sentences(own)


def records(docs: DataFrame) -> DataFrame:
    """(sample_id, context, claim) of documents: the first sentence is the claim, the others the context."""
    return samples_of(docs).where(F.size("sentences") > 0).select("sample_id", F.array_join("sentences", "\n").alias("context"), "claim")
