import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm.distinct import Registers, distinct_counts, distinct_states, merged, overlaps

KIND = Registers(m=1024, capacity=100, carried=300)


@pytest.fixture(scope="module")
def frame(spark):
    """Group g holds the multiples of g below 60,000, each twice, and some nulls."""
    ids = spark.range(60_000).select("id", F.explode(F.array(*map(F.lit, (1, 2, 3, 1000, 1)))).alias("g")).where("id % g = 0")
    extra = spark.createDataFrame([(None, 1), (None, 77), (5, None)], "id long, g int")
    return ids.unionByName(extra).withColumns({"value": F.col("id").cast("string"), "n_distinct": F.lit("clash"), "half": (F.col("id") >= 30_000).cast("int")}).repartition(5).cache()


TRUE = {1: 60_000, 2: 30_000, 3: 20_000, 1000: 60, None: 1}


def test_counts_are_within_their_error(frame):
    rows = {r["g"]: r for r in distinct_counts(distinct_states(frame, ["g"], "value", KIND), ["g"], KIND).collect()}
    assert set(rows) == set(TRUE)
    for g, n in TRUE.items():
        assert abs(rows[g]["n_distinct"] - n) <= 4 * rows[g]["standard_error"]
        assert (rows[g]["standard_error"] == 0) == (n <= 100)


def test_merging_parts_gives_the_same_sketch(frame):
    whole = distinct_states(frame, ["g"], "value", KIND)
    parts = merged(distinct_states(frame, ["half", "g"], "value", KIND, merge=False), ["g"], KIND)
    assert {(r["g"], bytes(r["sketch"] or b""), tuple(r["codes"])) for r in whole.collect()} == {(r["g"], bytes(r["sketch"] or b""), tuple(r["codes"])) for r in parts.collect()}


@pytest.mark.parametrize("one, two, union, both", [(2, 3, 40_000, 10_000), (1, 2, 60_000, 30_000), (2, 1000, 30_000, 60), (1000, 1000, 60, 60), (2, 2, 30_000, 30_000)])
def test_joint_estimates(frame, one, two, union, both):
    states = distinct_states(frame, ["g"], "value", KIND).select("g", F.struct("codes", "counts", "sketch").alias("s"))
    pair = states.where(f"g = {one}").select(F.lit(1).alias("k"), F.col("s").alias("left")).join(states.where(f"g = {two}").select(F.lit(1).alias("k"), F.col("s").alias("right")), "k")
    r = overlaps(pair, ["k"], KIND).first()
    assert abs(r["jaccard"] - both / union) <= 4 * r["jaccard_error"] + 1e-9
    assert abs(r["n_union"] / union - 1) < 0.15
    assert abs(r["n_both"] - both) <= 4 * r["jaccard_error"] * union + 0.15 * both


def test_disjoint_exact_and_missing(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("b", 4)], "g string, v long")
    s = distinct_states(frame, ["g"], "v", KIND).select("g", F.struct("codes", "counts", "sketch").alias("s"))
    pair = s.where("g = 'a'").select(F.col("s").alias("left")).join(s.where("g = 'b'").select(F.col("s").alias("right")))
    assert tuple(overlaps(pair, [], KIND).first()) == (2, 3, 4, 1, 0.25, 0)
    alone = s.where("g = 'a'").select(F.col("s").alias("left"), F.lit(None).cast(s.schema["s"].dataType).alias("right"))
    assert tuple(overlaps(alone, [], KIND).first()) == (2, 0, 2, 0, 0, 0)


@pytest.mark.parametrize("b", [1.001, 1.2, 2.0])
def test_the_base_can_be_chosen(b):
    kind = Registers(m=2048, b=b)
    rng = np.random.default_rng(3)
    for n in (1, 50, 5_000, 200_000):
        sketch = kind.empty()
        kind.add(sketch, rng.integers(-(2**63), 2**63, n, dtype=np.int64))
        assert abs(kind.count(sketch) / n - 1) < 4.5 * kind.relative_error


def test_empty(frame):
    states = distinct_states(frame.limit(0), ["g"], "value", KIND)
    assert states.count() == 0 and distinct_counts(states, ["g"], KIND).count() == 0
    with pytest.raises(ValueError):
        Registers(m=1000)
