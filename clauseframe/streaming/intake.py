"""Documents that come again: each text of a document is split once, however often it is delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseframe.plans import api


def new_versions(docs: DataFrame, delay: str = "1 day", id_col: str = "law_id", text: str = "text", at: str = "arrived") -> DataFrame:
    """Of a stream of deliveries (id, text, arrived), the first of each text of an id; a changed text is a new version, with its content_hash.

    Ids and hashes are held as state for as long as a repeat may be late: `delay` behind the latest delivery. What repeats later
    than that is split again, what is older than that when it comes is dropped by the watermark.
    """
    hashed = docs.withColumn("content_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return hashed.withWatermark(at, delay).dropDuplicatesWithinWatermark([id_col, "content_hash"])


def write_versions(docs: DataFrame, path: str, checkpoint: str, delay: str = "1 day", available_now: bool = True):
    """Append a row for each version, with its fragments; a restart goes on with the state in the checkpoint."""
    split = api.split_documents(new_versions(docs, delay)).select("law_id", "arrived", "content_hash", "fragments", "error")
    writer = split.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current(versions: DataFrame) -> DataFrame:
    """Of written versions, the latest of each id."""
    return versions.groupBy("law_id").agg(F.max_by(F.struct("arrived", "content_hash", "fragments", "error"), F.struct("arrived", "content_hash")).alias("v")).select("law_id", "v.*")
