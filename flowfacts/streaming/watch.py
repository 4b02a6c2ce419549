"""Incremental checks: files that appear or change below a folder begin a batch; a batch brings the store up to the project, and
parses only what has a content the store does not know."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from flowfacts.plans.store import Store
from flowfacts.sources.dependencies import read_files
from flowfacts.sources.project_files import project_stream


def update(files: DataFrame, store: str) -> DataFrame:
    """(module) of the modules of files (path, text) to analyse again, after the store in a folder was brought up to them."""
    return Store(files.sparkSession, store).update(files)


def watch(spark: SparkSession, root: str, store: str, checkpoint: str) -> StreamingQuery:
    """Start a query that updates the store whenever files below root are new or edited; each batch reads the project as it is then."""

    def batch(changed: DataFrame, number: int) -> None:
        if not changed.isEmpty():
            update(read_files(spark, root, "*.py"), store)

    return project_stream(spark, root, "*.py").select("path", "changed").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
