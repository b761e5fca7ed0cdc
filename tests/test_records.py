import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.operators.records import MENU_ITEM, Field, _Loader, load_records, split_strict

REST = ",20,3,2015-05-01 00:29:03 UTC,bad,0.5,"


@pytest.mark.parametrize(
    "raw, reason",
    [
        ("1,10,2.5" + REST, None),
        (' 007 ,10,"2.5"' + REST, None),
        ("9223372036854775807,10,.5e-3" + REST, None),
        ('"1",10,None' + REST, None),
        ("1,10,nan" + REST, None),
        ("1,10,+2." + REST, None),
        ("1,10,1e999" + REST, None),
        ("1,10,2\n" + REST, "price"),
        ('1,"a\nb",2' + REST, None),
        ("1,a\nb,2" + REST, None),
        ('1,"a\x01\n""b"",",2' + REST, None),
        ("0,10,2" + REST, "id"),
        ("9223372036854775808,10,2" + REST, "id"),
        ("+1,10,2" + REST, "id"),
        ("1.0,10,2" + REST, "id"),
        ("１,10,2" + REST, "id"),
        (",10,2" + REST, "id"),
        ("x,10,x" + REST, "id"),
        ("1,10,NaN" + REST, "price"),
        ("1,10,Infinity" + REST, "price"),
        ("1,10,0x1F" + REST, "price"),
        ("1,10,." + REST, "price"),
        ("1,10,2e" + REST, "price"),
        ('1,10,"2,5"' + REST, "price"),
        ("x,10,2", "columns"),
        ("", "columns"),
        (None, "columns"),
        ('x,10,"2', "quoting"),
        ('1,10,"2"x' + REST, "quoting"),
        ('1,1"0,2' + REST, "quoting"),
        ('""1"",10,2' + REST, "quoting"),
        ('"1" ,10,2' + REST, "quoting"),
    ],
)
def test_reason(raw, reason):
    good = "5,6,7" + REST
    for records in ([raw], [good] * 40 + [raw] + [good] * 60):
        loader = _Loader(MENU_ITEM)
        reasons, typed = loader.batch(records)
        expected = [reason if r is raw else None for r in records]
        assert reasons.to_pylist() == expected
        assert [r is None for r in typed.to_pylist()] == [r is not None for r in expected]


def test_types():
    _, typed = _Loader(MENU_ITEM).batch(["7,x,None,nan,-3,2015-05-01 00:29:03 UTC,2015-02-30 00:00:00,1e999, 2 "])
    row = typed[0].as_py()
    assert (row["id"], row["menu_page_id"], row["price"], row["dish_id"], row["xpos"], row["ypos"]) == (7, None, None, -3, float("inf"), 2.0)
    assert row["high_price"] != row["high_price"]
    assert str(row["created_at"]) == "2015-05-01 00:29:03" and row["updated_at"] is None


CELL = st.text(alphabet='ab1,"\n\r\x01 .', max_size=5)
SPEC = (Field("id", "key", judged=True), Field("note", "number"), Field("price", "number", judged=True))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet='1,"\n\r\x01 .e', max_size=9), st.tuples(st.sampled_from(["1", " 2 ", '"3"', "x"]), CELL, st.sampled_from(["", "1.5", "y", '"2"'])).map(",".join)), min_size=33, max_size=90))
def test_blocks_agree_with_the_strict_reader(records):
    loader = _Loader(SPEC)
    assert loader.batch(records)[0].to_pylist() == [_Loader(SPEC).strict(r)[1] for r in records]
    good = [r for r in records if loader.strict(r)[1] is None]
    plain = [r for r in good if not set(r) & set("\n\r")]
    fields = loader.columns(plain) if plain else None
    if fields is not None:
        assert [list(r) for r in zip(*(f.to_pylist() for f in fields))] == [split_strict(r) for r in plain]


def test_only_isolated_records_are_read_strictly():
    """At the rate of bad records of the test tables, all good records go the columnar way."""
    good = ["5,6,7" + REST, ' 07 ,"a ""b""",.5e3' + REST, '1,"a\nb",None' + REST, '9223372036854775807,,"nan"' + REST]
    bad = ["x,10,2" + REST, "1,2", '1,"2', "1,10,2e" + REST]
    for every in (2, 15, 1000):
        records = [bad[i % 4] if i % every == every - 1 else good[i % 4] for i in range(6000)]
        loader = _Loader(MENU_ITEM)
        reasons, _ = loader.batch(records)
        failed = sum(r is not None for r in reasons.to_pylist())
        assert failed == 6000 // every == loader.strictly
        assert loader.tried < 6000 * min(2, 30 / every)


def test_records_by_path(small):
    """On the test tables, the strict reader sees the records that fail and hardly any other."""
    import pyarrow.parquet as pq

    loader = _Loader(MENU_ITEM)
    reasons, _ = loader.batch(pq.read_table(f"{small}/menuitem_raw.parquet", columns=["raw"]).column("raw").to_pylist())
    failed = sum(r is not None for r in reasons.to_pylist())
    assert failed and loader.strictly <= failed + len(reasons) // 100


def test_operator(spark):
    frame = spark.createDataFrame([(1, "1,2,3"), (2, "1,2"), (3, None), (3, "1,2,3")], "k long, raw string").withColumns({"id": F.lit("clash"), "record": F.lit(0)})
    out = load_records(frame, keep=["k", "id"], spec=SPEC)
    assert out.columns == ["k", "id", "reason", "record"]
    assert sorted((r["k"], r["id"], r["reason"] or "", r["record"] is None) for r in out.collect()) == [
        (1, "clash", "", False), (2, "clash", "columns", True), (3, "clash", "", False), (3, "clash", "columns", True),
    ]
    assert load_records(frame.limit(0), keep=["k"]).count() == 0
    with pytest.raises(ValueError):
        load_records(frame, keep=["record"])


def test_very_long_record(spark):
    long = '1,"' + "x" * 3_000_000 + '",2'
    out = load_records(spark.createDataFrame([(long,), (long[:-3],)], "raw string"), spec=SPEC)
    assert sorted(r["reason"] or "" for r in out.collect()) == ["", "quoting"]
