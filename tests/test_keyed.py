import pytest
from pyspark.sql import functions as F

from tessella.operators.keyed import aggregate_by_key, heavy_keys

ROWS = [("a", 1, "u"), ("a", None, "v"), ("a", 5, "u"), (None, 7, "w"), ("b", None, None), ("b", None, "w"), ("b", 1, "w")]
AGGREGATES = {"n": ("count", None), "k": ("count", "v"), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "mean": ("avg", "v")}


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(ROWS, "key string, v long, who string").withColumn("n", F.lit("clash"))


def test_with_and_without_distinct(frame):
    expected = {"a": (3, 2, 6, 1, 5, 3.0, 2), None: (1, 1, 7, 7, 7, 7.0, 1), "b": (3, 1, 1, 1, 1, 1.0, 1)}
    plain = {r["key"]: tuple(r)[1:] for r in aggregate_by_key(frame, ["key"], AGGREGATES).collect()}
    both = {r["key"]: tuple(r)[1:] for r in aggregate_by_key(frame, ["key"], AGGREGATES, {"people": "who"}).collect()}
    assert both == expected and plain == {k: v[:-1] for k, v in expected.items()}


def test_distinct_of_the_key_itself(frame):
    assert {tuple(r) for r in aggregate_by_key(frame, ["key"], {}, {"d": "key"}).collect()} == {("a", 1), ("b", 1), (None, 0)}


def test_empty_and_refused(frame):
    assert aggregate_by_key(frame.limit(0), ["key"], AGGREGATES, {"d": "who"}).count() == 0
    with pytest.raises(ValueError):
        aggregate_by_key(frame, ["key"], {"m": ("median", "v")})


def test_only_partial_states_are_shuffled(spark):
    skewed = spark.range(0, 200_000, numPartitions=4).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key"), F.col("id").alias("v"))
    plan = aggregate_by_key(skewed, ["key"], {"s": ("sum", "v")})._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_sum") > plan.index("Exchange")


def test_heavy_keys(spark):
    rows = [("x", None)] * 19 + [("y", "z")] + [(None, "z")] * 5
    frame = spark.createDataFrame(rows, "a string, b string")
    assert {tuple(r) for r in heavy_keys(frame, ["a", "b"], 5).collect()} == {("a", "x", 19), ("a", "y", 1), ("b", "z", 6)}
    assert {tuple(r) for r in heavy_keys(frame, ["a"], 6).collect()} == {("a", "x", 19)}
    assert heavy_keys(frame.limit(0), ["a", "b"], 5).count() == 0
