"""A training corpus from documents: quality classifier, near duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs; all but
the last return the columns of documents, whatever further ones docs has. Rows are told apart by keys of their own wherever a
stage removes rows, so null and repeated ids lose nothing. An empty table gives an empty one at every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import materialize, shared_dir, table, tune, unused
from lodestar.llm.ngram_join import ngram_components
from lodestar.llm.packing import pack_documents
from lodestar.llm.quality import rated_model, selected_rows
from lodestar.llm.secrets import redact
from lodestar.llm.substring_dedup import without_repeats


def _counted(docs: DataFrame, names: list[str]) -> DataFrame:
    """docs with n_chars as its texts have it now; a null text keeps what it had."""
    n = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars") if "n_chars" in names else None
    return docs.select(*(n.alias(c) if c == "n_chars" else c for c in names))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier selects stay; without any rating all do."""
    tune(spark)
    return selected_rows(docs, rated_model(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of the n-gram join the row with the smallest id stays, null ids last. Rows have keys of their own here, as
    ids may be null or repeat; texts without words are classes of their own."""
    tune(spark)
    row, none = unused(docs, "row"), unused(docs, "none")
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    classes = ngram_components(keyed, id_col=row).select(F.col("doc_id").alias(row), F.col("component_id").alias(none))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)).alias("first")
    kept = keyed.select(row, "doc_id").join(classes, row).groupBy(none).agg(first).select(F.col(f"first.{row}").alias(row))
    return keyed.join(kept, row, "left_semi").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that start earlier go; a character cut in two goes with them. n_chars follows."""
    tune(spark)
    return _counted(without_repeats(docs), docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are masked. n_chars follows."""
    tune(spark)
    return _counted(redact(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 1024 ids."""
    tune(spark)
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("secrets", secrets), ("packing", packing)]
#: The classifier, the repeated passages and the tokeniser have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. What a stage wrote goes once the next one has written its own."""
    docs, before = table(spark, sf_dir, "documents"), None
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            fs(before).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(fs(before), True)
        before = path
    return docs
