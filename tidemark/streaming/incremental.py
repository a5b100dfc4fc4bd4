"""Incremental ingest as a stream: the checkpoint remembers which files were seen.

One run takes every file that appeared since the last one and ends. The file source never returns to a
path it has seen, so changed files still go through ``sources.ingest.ingest_all``; both write the same
registry and raw tables, and a micro-batch that is repeated after a failure finds its files registered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources import ingest
from tidemark.sources.schemas import SINGLE, Dataset


def arriving_files(spark: SparkSession, root: str, dataset: Dataset) -> DataFrame:
    """A stream of (dataset, source_path, filename, md5, modified_time, file_size, header)."""
    reader = spark.readStream.format("binaryFile").schema(
        "path string, modificationTime timestamp, length bigint, content binary"
    )
    folder = root if dataset.layout == SINGLE else f"{root}/{dataset.path}"
    pattern = dataset.path if dataset.layout == SINGLE else "*.csv"
    return ingest.file_entries(reader.option("pathGlobFilter", pattern).load(folder), dataset)


def ingest_new_files(
    spark: SparkSession, root: str, dataset: Dataset, raw_root: str, registry_path: str, checkpoint: str
) -> None:
    """Ingest the files that arrived since the last call, then stop."""

    def batch(files: DataFrame, batch_id: int) -> None:
        ingest.ingest_dataset(spark, dataset, files, raw_root, registry_path)

    stream = (
        arriving_files(spark, root, dataset)
        .writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()

