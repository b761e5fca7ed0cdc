import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.llm.topn import top_n_per_group

SCHEMA = "g string, h string, score double, id long, __id string"


def brute(rows, n):
    groups = {}
    for g, h, score, ident, _ in rows:
        if score is not None:
            groups.setdefault((g, h), []).append((score, ident))
    out = []
    for key, members in groups.items():
        order = sorted(members, key=lambda m: (-m[0], m[1] is None, m[1] or 0))
        seen, rank = set(), 0
        for score, ident in order:
            if ident in seen and ident is not None:
                continue
            seen.add(ident)
            rank += 1
            if rank <= n:
                out.append((*key, ident, score, rank))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 3, 7])
def test_against_brute_force(spark, n):
    rng = random.Random(n)
    rows = [
        ("hot" if rng.random() < 0.4 else rng.choice(["a", "b", None, "c"]), rng.choice(["x", None]), rng.choice([None, 0.0, 1.0, 2.0, 5.5]), rng.choice([None, *range(40)]), "clash")
        for _ in range(3000)
    ]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = top_n_per_group(frame.withColumn("rank", F.lit(1)), ["g", "h"], "score", "id", n)
    assert found.columns == ["g", "h", "id", "score", "rank_in_group"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, n)


def test_group_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        frame = spark.range(0, 5000, numPartitions=3).select(F.lit("only").alias("g"), (F.col("id") % 100).alias("id"), (F.col("id") % 7).alias("score"))
        found = [(r["id"], r["score"]) for r in top_n_per_group(frame, ["g"], "score", "id", 60).orderBy("rank_in_group").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == [(i, 6) for i in range(60)]


def test_empty(spark):
    assert top_n_per_group(spark.createDataFrame([], SCHEMA), ["g"], "score", "id", 3).count() == 0
    with pytest.raises(ValueError):
        top_n_per_group(spark.createDataFrame([], SCHEMA), ["g"], "score", "id", 0)


def test_at_most_n_rows_a_group_and_partition_are_shuffled(spark):
    frame = spark.range(0, 100_000, numPartitions=4).select(F.lit("hot").alias("g"), F.col("id"), F.col("id").alias("score"))
    plan = top_n_per_group(frame, ["g"], "score", "id", 2)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange") :]
    assert plan.count("Exchange") == 1 and "MapInArrow" in below


def test_a_group_of_a_million_rows(spark):
    """One group in many batches, each identifier delivered twice, among small groups."""
    rows = spark.range(1_000_000).select(
        F.when(F.col("id") % 50 == 0, F.col("id") % 1000).otherwise(F.lit(-1)).alias("g"), (F.col("id") % 500_000).alias("i"), (F.pmod(F.xxhash64(F.col("id") % 500_000), F.lit(10_000))).alias("s")
    )
    found = {tuple(r) for r in top_n_per_group(rows, ["g"], "s", "i", 5).collect()}
    ranked = rows.distinct().withColumn("rank_in_group", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("s"), "i"))).where("rank_in_group <= 5")
    assert found == {(r["g"], r["i"], r["s"], r["rank_in_group"]) for r in ranked.collect()} and len(found) == 5 * 21
