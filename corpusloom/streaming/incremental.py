"""Incremental indexing of a stream of documents: each micro-batch adds to the index, a document sent again replaces itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators import index


def index_stream(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's postings and document ids under ``batch=<id>``; a batch that runs again overwrites its own folders."""

    def add(batch: DataFrame, number: int) -> None:
        batch.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id >= 0").distinct().write.mode("overwrite").parquet(f"{path}/documents/batch={number}")
        index.postings(index.corpus(batch)).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, term, tf)`` of each document's newest version; one whose newest version has no words has no postings."""
    newest = spark.read.parquet(f"{path}/documents").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{path}/postings").join(newest, ["doc_id", "batch"]).select("doc_id", "term", "tf")
