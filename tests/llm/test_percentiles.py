import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import keyed
from tessella.llm.percentiles import Dyadic, decode_double, encode_double, merged, negated, percentile_states, percentiles

SHARES = [0.001, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
KIND = Dyadic(width=512, capacity=64, carried=200)


def rank_error(values, share, answer):
    """How far the answer's ranks are from the rank asked for."""
    values = np.sort(values)
    rank = max(1, np.ceil(share * len(values)))
    low, high = np.searchsorted(values, answer, "left") + 1, np.searchsorted(values, answer, "right")
    return 0 if low <= rank <= high else min(abs(low - rank), abs(high - rank))


def checked(rows, data, exact):
    for r in rows:
        values = data[r["g"]]
        assert r["n"] == len(values)
        assert (r["rank_error"] == 0) == exact[r["g"]]
        assert rank_error(values, r["share"], r["value"]) <= r["rank_error"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    return {
        "hot": np.round(rng.lognormal(3, 2, 30_000), 3),
        "ties": rng.integers(-20, 20, 20_000) / 4.0,
        "negative": rng.normal(-5, 100, 4_000),
        "few": np.array([1.0, 1.0, 2.0, -0.0, float("inf")]),
        "zeros": np.zeros(500),
    }


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = [(g, float(v)) for g, values in data.items() for v in values] + [("few", None), ("few", float("nan")), ("none", None), (None, 3.0)]
    return spark.createDataFrame(rows, "g string, v double").withColumns({"n": F.lit("clash"), "day": (F.rand(1) * 3).cast("int")}).repartition(6).cache()


EXACT = {"hot": False, "ties": True, "negative": False, "few": True, "zeros": True, None: True}


def test_codes_sort_as_numbers():
    values = np.array([-np.inf, -1e300, -2.5, -1e-300, -0.0, 0.0, 1e-300, 2.5, 1e300, np.inf])
    codes = encode_double(values)
    assert (np.diff(codes) >= 0).all() and codes[4] == codes[5] and (decode_double(codes) == values).all()


def test_error_stays_within_its_bound(frame, data):
    rows = percentiles(percentile_states(frame, ["g"], "v", KIND), ["g"], SHARES, KIND).collect()
    assert {r["g"] for r in rows} == {*data, None} and len(rows) == 6 * len(SHARES)
    checked(rows, {**data, None: np.array([3.0])}, EXACT)


def test_days_merge_to_the_same_sketch(frame):
    whole = percentile_states(frame, ["g"], "v", KIND)
    days = percentile_states(frame, ["day", "g"], "v", KIND)
    one, other = ({(r["g"], r["share"]): (r["n"], r["value"]) for r in percentiles(s, ["g"], SHARES, KIND).collect()} for s in (whole, merged(days, ["g"], KIND)))
    assert one == other


def test_values_can_be_taken_out_again(frame, data):
    whole = percentile_states(frame, ["g"], "v", KIND)
    taken = negated(percentile_states(frame.where("v > 10"), ["g"], "v", KIND), KIND)
    rows = percentiles(merged(whole.unionByName(taken), ["g"], KIND), ["g"], SHARES, KIND).collect()
    left = {g: v[v <= 10] for g, v in data.items()}
    checked(rows, {**left, None: np.array([3.0])}, EXACT)
    all_out = merged(whole.unionByName(negated(whole, KIND)), ["g"], KIND)
    assert percentiles(all_out, ["g"], SHARES, KIND).count() == 0


def test_merging_in_stages_gives_the_same_sketch(frame, monkeypatch):
    whole = percentile_states(frame, ["g"], "v", KIND)
    monkeypatch.setattr(keyed, "FAN", 2)
    staged = percentile_states(frame, ["g"], "v", KIND)
    plan = staged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") >= 3
    one, other = ({(r["g"], r["share"]): (r["n"], r["value"]) for r in percentiles(s, ["g"], SHARES, KIND).collect()} for s in (whole, staged))
    assert one == other


def test_weights(spark):
    frame = spark.createDataFrame([(5, 3), (7, 1), (9, None), (5, -3), (8, 1)], "v long, w long")
    rows = percentiles(percentile_states(frame, [], "v", weight="w"), [], [0.5, 1.0]).collect()
    assert [tuple(r) for r in rows] == [(2, 0.5, 7.0, 0), (2, 1.0, 8.0, 0)]


def test_empty_and_refused(spark, frame):
    states = percentile_states(frame.limit(0), ["g"], "v", KIND)
    assert states.count() == 0 and percentiles(states, ["g"], SHARES, KIND).count() == 0
    with pytest.raises(ValueError):
        percentile_states(frame.withColumn("codes", F.lit(1)), ["codes"], "v")
    with pytest.raises(ValueError):
        Dyadic(width=1000)
