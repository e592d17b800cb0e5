"""Samples that arrive as files, through the cascade; each sample is complete in itself, so there is no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.cascade import FilterCascade
from ..operators.samples import candidates


def cascade_stream(spark: SparkSession, docs_path: str, out: str, checkpoint: str, schema) -> StreamingQuery:
    """Document files under docs_path as they come; evidence rows are appended to out."""

    def step(batch: DataFrame, _: int) -> None:
        FilterCascade().transform(candidates(batch)).write.mode("append").parquet(out)

    return spark.readStream.schema(schema).parquet(docs_path).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
