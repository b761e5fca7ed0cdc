import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import mixing
from tessella.llm.mixing import apportion, count_tokens, default_tokenizer, mix_sources, pfair

TARGETS = "source string, target_share double, max_repeats int"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=1, max_size=9))
def test_every_prefix_is_within_a_block_of_every_share(sizes):
    blocks = {f"s{i}": n for i, n in enumerate(sizes)}
    order, total = list(pfair(blocks)), sum(sizes)
    slots = [s for s, _ in order]
    assert sorted(order) == [(s, i) for s in sorted(blocks) for i in range(blocks[s])]
    given_so_far = dict.fromkeys(blocks, 0)
    for t, s in enumerate(slots, 1):
        given_so_far[s] += 1
        for name, n in blocks.items():
            assert abs(given_so_far[name] - t * n / total) < 1
    assert given_so_far == blocks


def test_apportion():
    assert apportion({"a": 0.5, "b": 0.3, "c": 0.2}, 10) == {"a": 5, "b": 3, "c": 2}
    dealt = apportion({"a": 0.98, "b": 0.01, "c": 0.01}, 10)
    assert sum(dealt.values()) == 10 and min(dealt.values()) == 1


def test_tokens_are_those_of_the_tokenizer(spark):
    texts = ["Hello world, hello!", "", None, "Ünïcödé " * 50, "x" * 20_000]
    frame = count_tokens(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string"), "text")
    from tessella.llm.mixing import _encoding

    encode = _encoding(*default_tokenizer()).encode_ordinary
    assert {tuple(r) for r in frame.collect()} == {(i, len(encode(t or ""))) for i, t in enumerate(texts)}


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(4)
    rows = [(i, s, "word " * rng.randint(1, 60)) for i, s in enumerate(["big"] * 3000 + ["small"] * 60 + ["mid"] * 400 + ["other"] * 50 + [None] * 20)]
    rows += [(9000, "big", None), (9001, "mid", "")]
    targets = [("big", 0.5, 1), ("small", 0.1, 4), ("mid", 0.3, 2), ("absent", 0.1, 3), ("none", None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("slot", F.lit("clash"))
    selection, report = mix_sources(frame, spark.createDataFrame(targets, TARGETS))
    return selection.collect(), {r["source"]: r for r in report.collect()}


def test_shares_and_repeats(mixed):
    selection, report = mixed
    assert set(report) == {"big", "small", "mid", "absent", "none"}
    share = {"big": 0.5 / 0.9, "small": 0.1 / 0.9, "mid": 0.3 / 0.9, "absent": 0, "none": 0}
    total = sum(r["n_tokens"] for r in selection)
    for s, r in report.items():
        assert r["share"] == pytest.approx(share[s])
        mine = [x for x in selection if x["source"] == s]
        assert r["selected_tokens"] == sum(x["n_tokens"] for x in mine)
        assert abs(r["selected_tokens"] - share[s] * total) <= 3 * 62
        assert r["actual_share"] == pytest.approx(r["selected_tokens"] / total)
        assert r["most_uses"] <= (r["max_repeats"] or 1)
    uses = {}
    for r in selection:
        uses.setdefault((r["source"], r["doc_id"]), []).append(r["use_no"])
    assert all(sorted(u) == list(range(1, len(u) + 1)) for u in uses.values())
    # the scarcest source is used up as often as allowed, and no document again before all others
    small = [len(u) for (s, _), u in uses.items() if s == "small"]
    assert min(r["max_repeats"] * r["available_tokens"] - r["selected_tokens"] for r in report.values() if r["n_documents"]) <= 62
    assert len(small) == 60 and max(small) - min(small) <= 1


def test_prefixes_by_slot_keep_the_shares(mixed):
    selection, report = mixed
    rows = sorted(selection, key=lambda r: (r["slot"], r["place"]))
    slots = rows[-1]["slot"] + 1
    total = sum(r["n_tokens"] for r in rows)
    block = total / slots
    got = dict.fromkeys(report, 0)
    at = 0
    for slot in range(slots):
        while at < len(rows) and rows[at]["slot"] == slot:
            got[rows[at]["source"]] += rows[at]["n_tokens"]
            at += 1
        for s, r in report.items():
            assert abs(got[s] - r["share"] * block * (slot + 1)) < 2 * block


def test_given_total_and_errors(spark):
    frame = spark.createDataFrame([(i, "ab"[i % 2], "one two three") for i in range(400)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.75, 1), ("b", 0.25, 1)], TARGETS)
    report = {r["source"]: r["selected_tokens"] for r in mix_sources(frame, targets, total_tokens=400)[1].collect()}
    assert abs(report["a"] - 300) <= 3 and abs(report["b"] - 100) <= 3
    selection, report = mix_sources(frame.limit(0), targets)
    assert selection.count() == 0 and {r["selected_tokens"] for r in report.collect()} == {0}
    with pytest.raises(ValueError):
        mix_sources(frame, targets.union(targets))


def test_order_of_many_blocks_is_joined_by_a_shuffle(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "ab"[i % 3 == 0], "word " * (1 + i % 7)) for i in range(2000)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 2)], TARGETS)
    each = sorted(map(tuple, mix_sources(rows, targets)[0].collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BLOCKS", 0)
    assert sorted(map(tuple, mix_sources(rows, targets)[0].collect())) == each and len(each) > 100
