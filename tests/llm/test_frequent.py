import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import frequent
from tessella.llm.frequent import frequent_values


@pytest.fixture(scope="module")
def words():
    rng = random.Random(5)
    return [None if rng.random() < 0.1 else f"w{int(rng.paretovariate(0.7)) % 5000}" for _ in range(20_000)]


@pytest.mark.parametrize("literals", [300, 1])
@pytest.mark.parametrize("k", [1, 10, 400, 100_000])
def test_top_k(spark, words, monkeypatch, literals, k):
    monkeypatch.setattr(frequent, "LITERALS", literals)
    frame = spark.createDataFrame([(w, 1, 2) for w in words], "v string, n long, p long").repartition(4)
    counts = Counter(w for w in words if w is not None)
    expected = sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:k]
    assert [tuple(r) for r in frequent_values(frame, "v", k=k).collect()] == expected


@pytest.mark.parametrize("share", [(1, 100), (1, 20), (1, 1), (1, 3000)])
def test_share(spark, words, share):
    counts = Counter(w for w in words if w is not None)
    total = sum(counts.values())
    expected = {(w, c) for w, c in counts.items() if c * share[1] >= total * share[0]}
    assert {tuple(r) for r in frequent_values(spark.createDataFrame([(w,) for w in words], "v string"), "v", min_share=share).collect()} == expected


def test_numbers_nulls_and_empty(spark):
    frame = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),), (None,), (2.0,)], "v double")
    assert [(str(r["value"]), r["n"]) for r in frequent_values(frame, "v", k=2).collect()] == [("0.0", 2), ("nan", 2)]
    for rows in (frame.limit(0), frame.where("v IS NULL")):
        assert frequent_values(rows, "v", k=3).count() == 0
        assert frequent_values(rows, "v", min_share=(1, 100)).count() == 0
    with pytest.raises(ValueError):
        frequent_values(frame, "v")


def test_ties_go_to_the_smaller_value(spark):
    frame = spark.createDataFrame([(i % 50,) for i in range(500)], "v long")
    assert [r["value"] for r in frequent_values(frame, "v", k=7).collect()] == list(range(7))


def test_no_rows_are_shuffled(spark, monkeypatch):
    """Prefixes become a filter; what is shuffled are partial counts alone."""
    monkeypatch.setattr(frequent, "LITERALS", 0)
    frame = spark.range(20_000).select((F.col("id") % 700).alias("v"))
    plan = frequent_values(frame, "v", k=600)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            assert "HashAggregate" in lines[i + 1] and "partial_count" in lines[i + 1]


def test_steps_that_would_keep_too_many_are_passed_over(spark, monkeypatch):
    monkeypatch.setattr(frequent, "KEPT", 3)
    frame = spark.range(3000).select((F.col("id") % 700).alias("v"))
    assert sorted(map(tuple, frequent_values(frame, "v", k=5).collect())) == [(v, 5) for v in range(5)]
