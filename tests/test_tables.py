import json

import pytest

from tessella.executor import QueryExecutor
from tessella.sources.files import read_source
from tessella.streaming.ingest import ingest_available
from tessella.table import Table

CSV = '﻿id,name,note\n1,"Smith, J.","two\nlines"\n\n2,"say ""hi""",\n3,short\n4,long,x,extra\n'


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def test_csv(spark, tmp_path):
    (tmp_path / "menu.csv").write_text(CSV, encoding="utf-8")
    frame = read_source(spark, str(tmp_path / "menu.csv"))
    assert frame.columns == ["id", "name", "note"]
    assert rows(frame) == [("1", "Smith, J.", "two\nlines"), ("2", 'say "hi"', ""), ("3", "short", ""), ("4", "long", "x")]


def test_tsv(spark, tmp_path):
    (tmp_path / "menu.TSV").write_text("a\tb\n1\tx,y\n")
    assert rows(read_source(spark, str(tmp_path / "menu.TSV"))) == [("1", "x,y")]


@pytest.mark.parametrize(
    "name, text",
    [
        ("array.json", json.dumps([{"a": 92, "b": True}, {"a": None, "c": "é"}], indent=2, ensure_ascii=False)),
        ("compact.json", json.dumps([{"a": 92, "b": True}, {"c": "é"}], ensure_ascii=False)),
        ("lines.json", '{"a": 92, "b": true}\n\n{"c": "é"}\n'),
        ("lines.ndjson", '\n{"a": 92, "b": true}\n{"c": "é"}\n'),
    ],
)
def test_json(spark, tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    frame = read_source(spark, str(tmp_path / name))
    assert frame.columns == ["a", "b", "c"]
    assert rows(frame) == [("92", "True", "None"), ("None", "None", "é")]


def test_json_object_and_mixed_numbers(spark, tmp_path):
    (tmp_path / "one.json").write_text('{\n "a": 5, "d": {"x": 1}}')
    assert rows(read_source(spark, str(tmp_path / "one.json"))) == [("5", '{"x":1}')]
    (tmp_path / "mixed.json").write_text('[{"a": 5}, {"a": 0.0}]')
    assert rows(read_source(spark, str(tmp_path / "mixed.json"))) == [("5",), ("0.0",)]


def test_refused_sources(spark, tmp_path):
    with pytest.raises(ValueError, match="unsupported"):
        read_source(spark, str(tmp_path / "x.xlsx"))
    (tmp_path / "empty.json").write_text("[]")
    with pytest.raises(ValueError, match="no columns"):
        read_source(spark, str(tmp_path / "empty.json"))
    with pytest.raises(ValueError, match="No segments found"):
        Table.from_data_dir(spark, str(tmp_path / "missing"))


def test_segments_are_contiguous_and_equal(spark, tmp_path):
    (tmp_path / "n.csv").write_text("n\n" + "".join(f"{i}\n" for i in range(100_001)))
    table = Table.from_ingest_source(spark, str(tmp_path / "t"), str(tmp_path / "n.csv"), 3)
    found = sorted((r["_segment"], r["count"]) for r in table.frame.groupBy("_segment").count().collect())
    assert found == [(0, 33_334), (1, 33_334), (2, 33_333)]
    assert table.frame.where("cast(n as long) <> _row").count() == 0
    assert QueryExecutor(table).execute("SELECT COUNT(*) AS c, SUM(n) AS s").get_results() == [[100_001, 5_000_050_000]]
    assert table.stats() == {"rows": 100_001, "columns": 1, "segments": 3}


def test_rows_are_numbered_over_many_partitions(spark, tmp_path):
    table = Table.write(spark.range(0, 1000, numPartitions=7), str(tmp_path / "t"), 11)
    assert table.segments == list(range(11))
    assert table.frame.where("id <> _row").count() == 0


def test_indexed_columns_get_bloom_filters(spark, tmp_path):
    frame = spark.range(200_000).selectExpr("cast(id * 7 as string) as k", "id % 3 as v")
    sizes = []
    for index in ((), ("k",)):
        path = tmp_path / f"t{len(index)}"
        table = Table.write(frame, str(path), 2, index=index)
        assert QueryExecutor(table).execute("SELECT v WHERE k = '77'").get_results() == [[2]]
        sizes.append(sum(f.stat().st_size for f in path.rglob("*.parquet")))
    assert sizes[1] > sizes[0]


def test_ingest_again_leaves_nothing_behind(spark, tmp_path):
    path = str(tmp_path / "t")
    Table.write(spark.range(100), path, 4)
    assert Table.write(spark.range(10), path, 2).stats() == {"rows": 10, "columns": 1, "segments": 2}


def test_more_segments_than_rows_and_none(spark, tmp_path):
    assert Table.write(spark.range(2), str(tmp_path / "a"), 9).segments == [0, 1]
    assert Table.write(spark.range(0), str(tmp_path / "b"), 2).frame.count() == 0
    with pytest.raises(ValueError):
        Table.write(spark.range(2), str(tmp_path / "c"), 0)


def test_append(spark, tmp_path):
    path = str(tmp_path / "t")
    table = Table.write(spark.range(10), path, 2).append(spark.range(5), path)
    assert table.stats() == {"rows": 15, "columns": 1, "segments": 3}
    assert table.frame.select("_row").distinct().count() == 15


def test_files_are_taken_in_once(spark, tmp_path):
    incoming, path, progress = (str(tmp_path / n) for n in ("in", "t", "p"))
    spark.range(10).write.parquet(incoming)
    assert ingest_available(spark, incoming, spark.range(1).schema, path, progress).frame.count() == 10
    spark.range(10, 15).write.mode("append").parquet(incoming)
    for _ in range(2):
        table = ingest_available(spark, incoming, spark.range(1).schema, path, progress)
        assert table.frame.select("id").distinct().count() == table.frame.count() == 15


def test_a_stream_goes_on_after_the_segments_there_are(spark, tmp_path):
    incoming, path = str(tmp_path / "in"), str(tmp_path / "t")
    old = spark.range(100, 102)
    Table.write(old, path, 2)
    spark.range(10).write.parquet(incoming)
    for progress, rows in (("p", 12), ("p", 12), ("q", 22)):  # a new progress folder takes everything in again, over nothing
        table = ingest_available(spark, incoming, old.schema, path, str(tmp_path / progress))
        assert table.frame.count() == rows
    assert table.segments == [0, 1, 2, 3]
    spark.range(10, 11).write.mode("append").parquet(incoming)
    assert sorted(r[0] for r in ingest_available(spark, incoming, old.schema, path, str(tmp_path / "p")).frame.select("id").collect()).count(10) == 1


def test_csv_is_split_where_no_cell_breaks_a_line(spark, tmp_path):
    plain, broken = tmp_path / "plain.csv", tmp_path / "broken.csv"
    plain.write_text('a,b\n1,"x, y"\n2,"say ""hi"""\n')
    broken.write_text('a,b\n1,"x\ny"\n')
    assert [tuple(r) for r in read_source(spark, str(plain)).collect()] == [("1", "x, y"), ("2", 'say "hi"')]
    assert [tuple(r) for r in read_source(spark, str(broken)).collect()] == [("1", "x\ny")]
    for path, lines in ((plain, False), (broken, True)):
        assert rows(read_source(spark, str(path))) == rows(read_source(spark, str(path), multi_line=lines))
