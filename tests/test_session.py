from pyspark.sql import functions as F

from tessella.executor import QueryExecutor
from tessella.session import SEMANTICS, partitions_of, spread
from tessella.table import Table


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    run()
    found = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(found)


def test_spreading_runs_nothing(spark):
    grouped = spark.range(1000, numPartitions=3).groupBy((F.col("id") % 7).alias("k")).count()
    assert jobs(spark, "spread-grouped", lambda: spread(grouped)) == 0
    assert partitions_of(spark.range(10, numPartitions=3)) == 3
    assert partitions_of(grouped.repartition(11)) == 11
    assert spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_semantics_in_any_session(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.caseSensitive", "false")
    frame = other.createDataFrame([(1, 2)], "a int, b int")
    QueryExecutor(Table.from_dataframe(frame))
    assert all(other.conf.get(k) == v for k, v in SEMANTICS.items())
