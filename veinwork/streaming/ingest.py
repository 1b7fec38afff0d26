"""Incremental ingest: new sections are read as a stream and their mentions kept in a table of entities.

Each micro-batch adds the mentions of its sections to a Parquet folder, partitioned by
batch, so that a batch that is run again after a failure replaces its own rows and adds
nothing twice. The current entities are an aggregate over that folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veinwork.operators.extract import entity_mentions


def section_stream(spark: SparkSession, folder: str, schema: str = "doc_id string, sec_no int, heading string, text string, level int, page int", most_files: int = 1000) -> DataFrame:
    """Sections from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(most_files)).parquet(folder)


def ingest(sections: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start the ingest of a stream of sections into a folder of mentions; with available_now it ends after what is there."""

    def add(batch: DataFrame, number: int) -> None:
        entity_mentions(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = sections.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_entities(spark: SparkSession, target: str) -> DataFrame:
    """(name, raw_type, n_mentions, n_documents): entities over all batches; sections delivered twice count once."""
    m = spark.read.parquet(target).select("doc_id", "sec_no", "pattern", "char_offset", "name", "raw_type").distinct()
    return m.groupBy("name").agg(F.min_by("raw_type", F.struct("doc_id", "sec_no", "pattern", "char_offset")).alias("raw_type"), F.count("*").alias("n_mentions"), F.count_distinct("doc_id").alias("n_documents"))
