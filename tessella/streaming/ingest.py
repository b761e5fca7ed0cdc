"""Appending to a table from files as they arrive."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.table import ROW, SEGMENT, Table


def _first_segment(spark: SparkSession, path: str, progress: str) -> int:
    """The segment of the stream's first batch: the one after those the table had when the stream first began."""
    kept = f"{progress.rstrip('/')}/first_segment"
    try:
        return spark.read.schema("first int").parquet(kept).first()["first"]
    except (AnalysisException, TypeError):  # no such folder, or one without its row
        pass
    try:
        there = spark.read.parquet(path)
    except AnalysisException:
        first = 0
    else:
        if SEGMENT not in there.columns:
            raise ValueError(f"the table in {path} is not cut into segments")
        first = there.agg(F.coalesce(F.max(SEGMENT), F.lit(-1))).first()[0] + 1
    spark.createDataFrame([(first,)], "first int").coalesce(1).write.mode("overwrite").parquet(kept)
    return first


def ingest_available(spark: SparkSession, incoming: str, schema: T.StructType, path: str, progress: str) -> Table:
    """Append the Parquet files of ``incoming`` that were not taken in before, one segment for each batch.

    ``progress`` is the folder in which the stream keeps what it has read and where its
    segments begin: after those that the table had before, however it was written. A
    batch that is repeated after a failure replaces its own segment and nothing else, so
    every file is taken in once. Only one stream may write to a table at a time. Rows
    within a segment are numbered by partition and place.
    """
    first = _first_segment(spark, path, progress)

    def store(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn(ROW, F.monotonically_increasing_id()).withColumn(SEGMENT, F.lit(first + number).cast("int"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(SEGMENT).parquet(path)

    stream = spark.readStream.schema(schema).parquet(incoming)
    stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{progress.rstrip('/')}/stream").trigger(availableNow=True).start().awaitTermination()
    return Table.from_data_dir(spark, path)
