"""The same pipeline on a stream: it is stateless by document, so nothing is held between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clauseframe.plans import api


def read_documents(spark: SparkSession, path: str, schema: str = "law_id string, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def write_fragments(docs: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append the fragments of each new document. The checkpoint makes a restart go on where it was."""
    writer = api.fragments_table(api.split_documents(docs)).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
