"""A table: a DataFrame over Parquet, cut into contiguous segments in the order of its rows."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import drop_folder, scratch_folder
from tessella.sources.files import read_source

SEGMENT, ROW = "_segment", "_row"
HIDDEN = (SEGMENT, ROW)


def _numbered(df: DataFrame) -> tuple[DataFrame, int, str]:
    """``df`` with each row's place in the order of its partitions, the number of rows, and a folder to be dropped afterwards.

    The input is run once and kept in the scratch folder with each row's partition and
    place in it, so that numbers hold together even where it would not come out alike
    twice. Only the partitions' sizes reach the driver; the rows are not shuffled.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark, "numbered")
    placed = df.withColumn("__part", F.spark_partition_id()).withColumn("__in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed.write.parquet(folder)
    placed = spark.read.schema(placed.schema).parquet(folder)
    sizes = {r["__part"]: r["count"] for r in placed.groupBy("__part").count().collect()}
    firsts, total = [], 0
    for part in sorted(sizes):
        firsts.append((part, total))
        total += sizes[part]
    starts = spark.createDataFrame(firsts, "__part int, __first long")
    # one row per partition of the input
    return placed.join(F.broadcast(starts), "__part").withColumn(ROW, F.col("__first") + F.col("__in")).drop("__part", "__in", "__first"), total, folder


class Table:
    """Rows to query, with the columns of the first segment as its schema."""

    def __init__(self, frame: DataFrame):
        self.frame = frame

    @classmethod
    def from_dataframe(cls, frame: DataFrame) -> Table:
        """Any DataFrame, with the types it has."""
        return cls(frame)

    @classmethod
    def from_data_dir(cls, spark: SparkSession, path: str) -> Table:
        """A table that was written before, segmented or not."""
        try:
            frame = spark.read.parquet(path)
        except AnalysisException as e:
            raise ValueError(f"No segments found in {path}") from e
        if not [c for c in frame.columns if c not in HIDDEN]:
            raise ValueError(f"No segments found in {path}")
        return cls(frame)

    @classmethod
    def from_ingest_source(
        cls, spark: SparkSession, path: str, source: str, num_segments: int = 1, typed: bool = False, multi_line: bool | None = None
    ) -> Table:
        """Read a file, write it as ``num_segments`` contiguous segments over whatever was at ``path``, and open it."""
        return cls.write(read_source(spark, source, typed, multi_line), path, num_segments)

    @classmethod
    def write(cls, frame: DataFrame, path: str, num_segments: int = 1, index: Sequence[str] = ()) -> Table:
        """Write a DataFrame as a table over whatever was at ``path``. Row i of n goes to segment i // ceil(n / num_segments).

        The columns of ``index`` get bloom filters, by which equality filters skip row groups
        that cannot hold their value; dictionaries and value ranges do so for every column.
        """
        if num_segments < 1:
            raise ValueError("num_segments must be at least 1")
        if set(HIDDEN) & set(frame.columns):
            raise ValueError(f"columns may not be named {' or '.join(HIDDEN)}")
        numbered, n, folder = _numbered(frame)
        size = max(1, ceil(n / num_segments))
        blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in index}
        numbered.withColumn(SEGMENT, F.floor(F.col(ROW) / size).cast("int")).write.mode("overwrite").options(**blooms).partitionBy(SEGMENT).parquet(path)
        if not n:
            return cls(numbered.withColumn(SEGMENT, F.lit(0)))
        drop_folder(frame.sparkSession, folder)
        return cls.from_data_dir(frame.sparkSession, path)

    def append(self, frame: DataFrame, path: str) -> Table:
        """Add rows as one more segment after those there are."""
        last = self.frame.agg(F.max(SEGMENT), F.max(ROW)).first()
        numbered, _, folder = _numbered(frame.select(*self.column_names()))
        after = numbered.withColumn(ROW, F.col(ROW) + F.lit((-1 if last[1] is None else last[1]) + 1))
        after.withColumn(SEGMENT, F.lit((-1 if last[0] is None else last[0]) + 1)).write.mode("append").partitionBy(SEGMENT).parquet(path)
        drop_folder(frame.sparkSession, folder)
        return Table.from_data_dir(frame.sparkSession, path)

    def column_names(self) -> list[str]:
        return [c for c in self.frame.columns if c not in HIDDEN]

    @property
    def segments(self) -> list[int]:
        """The numbers of the segments; a table that is not cut is one segment."""
        if SEGMENT not in self.frame.columns:
            return [0]
        return sorted(r[0] for r in self.frame.select(SEGMENT).distinct().collect())

    def stats(self) -> dict[str, int]:
        return {"rows": self.frame.count(), "columns": len(self.column_names()), "segments": len(self.segments)}
