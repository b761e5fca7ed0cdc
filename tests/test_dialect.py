import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.executor import QueryExecutor
from tessella.plans.parser import ParseError, parse
from tessella.table import Table

EDITS = [
    {"city": "Oak", "country": "A", "added": 9, "share": 0.5, "robot": True, "flags": ""},
    {"city": None, "country": "A", "added": 28, "share": 1.9, "robot": False, "flags": "x"},
    {"city": "Elm", "country": "B", "added": None, "share": 0.25, "robot": True, "flags": ""},
    {"city": "Elm", "country": "B", "added": 7, "share": 0.25, "robot": False, "flags": ""},
    {"city": "Oak", "country": "B", "added": 100, "share": 2.75, "robot": False, "flags": "y"},
]


def stored(spark, tmp_path, rows, segments=1):
    source = tmp_path / "rows.json"
    source.write_text(json.dumps(rows))
    return Table.from_ingest_source(spark, str(tmp_path / f"table{segments}"), str(source), segments)


@pytest.fixture(scope="module", params=[1, 2, 5])
def edits(request, spark, tmp_path_factory):
    return QueryExecutor(stored(spark, tmp_path_factory.mktemp("edits"), EDITS, request.param))


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("SELECT COUNT(added) AS c", [[5]]),  # counts rows, not values
        ("SELECT SUM(share) AS s", [[3]]),  # 0 + 1 + 0 + 0 + 2: truncated one by one
        ("SELECT AVG(added) AS a", [[28.8]]),  # null counts as 0 and in the number
        ("SELECT city, COUNT(*) AS c FROM whatever GROUP BY city ORDER BY city", [["Elm", 2], ["None", 1], ["Oak", 2]]),
        ("SELECT city, COUNT(*) AS c GROUP BY city ORDER BY city DESC LIMIT 1", [["Oak", 2]]),
        ("SELECT country, COUNT(DISTINCT city) AS n GROUP BY country ORDER BY country", [["A", 2], ["B", 2]]),
        ("SELECT added, SUM(added) AS s WHERE country = 'A' GROUP BY added ORDER BY SUM(added)", [["9", 9], ["28", 28]]),
        ("SELECT added WHERE country = 'A' ORDER BY added DESC", [["9"], ["28"]]),  # as texts
        ("SELECT added + 1 AS v WHERE country = 'B' ORDER BY added + 1 DESC LIMIT 2", [[101], [8]]),
        ("SELECT added / 2 + share AS v WHERE added = '9'", [[4]]),  # 4.5 and 0.5 are truncated again
        ("SELECT robot WHERE robot = 'True' AND city = 'Oak'", [["True"]]),
        ("SELECT flags, city WHERE flags = '' AND 'Oak' = city", [["", "Oak"]]),
        ("SELECT SUM(added + share) AS s", [[147]]),
        ("SELECT COUNT(*) + SUM(added) AS v, SUM(added) / COUNT(*) AS r", [[149, 28.8]]),
        ("SELECT COUNT(*) AS c WHERE city = 'nowhere'", []),
        ("SELECT city, COUNT(*) AS c WHERE city = 'nowhere' GROUP BY city", []),
        ("SELECT COUNT(*) AS c WHERE added = 28", [[1]]),
        ("SELECT COUNT(*) AS c WHERE 1 = 1", [[5]]),
        ("SELECT COUNT(*) AS c WHERE city = country", []),
        ("SELECT city GROUP BY city ORDER BY SUM(added) DESC LIMIT 1", [["Oak"]]),
        ("SELECT city, COUNT(*) AS c GROUP BY city HAVING c > 1 AND NOT city = 'Elm'", [["Oak", 2]]),
        ("SELECT COUNT(*) AS c WHERE added > 8 AND city IN ('Oak', 'None')", [[3]]),
        ("SELECT COUNT(*) AS c WHERE city LIKE 'E%' OR city BETWEEN 'N' AND 'Nz'", [[3]]),
        ("SELECT 7 AS a, 'it''s' AS b LIMIT 1", [[7, "it's"]]),
        ('SELECT `city`, "country" WHERE added = \'7\'', [["Elm", "B"]]),
    ],
)
def test_statement(edits, sql, expected):
    assert edits.execute(sql).get_results() == expected


def test_star_hides_what_is_internal(edits):
    assert edits.execute("SELECT * LIMIT 1").columns == edits.table.column_names() == sorted(EDITS[0])


def test_names_without_alias(edits):
    assert edits.execute("SELECT count(added), SUM(added) / COUNT(*)").columns == ["COUNT(added)", "SUM(added) / COUNT(*)"]


def test_ties_go_to_the_later_row_of_a_segment(spark, tmp_path):
    executor = QueryExecutor(stored(spark, tmp_path, [{"k": "x", "i": i} for i in range(6)], 2))
    assert executor.execute("SELECT i ORDER BY k LIMIT 4").get_results() == [["2"], ["1"], ["0"], ["5"]]


@pytest.mark.parametrize(
    "sql, error",
    [
        ("SELECT nope", ValueError),
        ("SELECT city, COUNT(*)", ValueError),
        ("SELECT city GROUP BY city + 1", ValueError),
        ("SELECT a FROM x JOIN y", ParseError),
        ("SELECT city UNION SELECT city", ParseError),
        ("SELECT city LIMIT 1 OFFSET 2", ParseError),
        ("SELECT city ORDER BY 1", ParseError),
        ("SELECT (SELECT city)", ParseError),
        ("SELECT MEDIAN(added)", NotImplementedError),
        ("SELECT SUM(SUM(added))", ValueError),
        ("SELECT city WHERE COUNT(*) = 1", ValueError),
        ("SELECT city FROM a, b", ParseError),
        ("SELECT", ParseError),
        ("SELECT city WHERE 'unclosed", ParseError),
    ],
)
def test_refused(edits, sql, error):
    with pytest.raises(error):
        edits.execute(sql)


def test_unknown_column_is_named(edits):
    with pytest.raises(ValueError, match="Unknown column 'nope' in query"):
        edits.execute("SELECT COUNT(*) WHERE nope = '1'")


def test_sum_of_words_fails(edits):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        edits.execute("SELECT SUM(country)")


def test_division_by_zero_fails(edits):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        edits.execute("SELECT added / 0 AS v")


def test_exact_numbers(spark, tmp_path):
    executor = QueryExecutor(stored(spark, tmp_path, EDITS), numeric="exact")
    assert executor.execute("SELECT SUM(share) AS s, AVG(share) AS a").get_results() == [pytest.approx([5.65, 1.13])]


def test_filter_and_columns_reach_the_scan(spark, small):
    executor = QueryExecutor(Table.from_dataframe(spark.read.parquet(f"{small}/menuitem.parquet")))
    plan = executor.dataframe("SELECT COUNT(*) AS c WHERE dish_id = '1' AND price = '0.25'")._jdf.queryExecution().toString()
    assert "EqualTo(dish_id,1)" in plan and "EqualTo(price,0.25)" in plan
    assert "ReadSchema: struct<price:double,dish_id:bigint>" in plan


def test_parse_is_stable():
    assert parse("select a from t where b = 'x' and (c = 1 or d <> 2) group by a order by a desc limit 3") == parse(
        "SELECT a FROM t WHERE b='x' AND (c=1 OR d!=2) GROUP BY a ORDER BY a DESC LIMIT 3;"
    )


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(-50, 50)), min_size=1, max_size=40), st.integers(1, 6))
def test_segments_make_no_difference(spark, tmp_path_factory, rows, segments):
    frame = spark.createDataFrame(rows, "k string, v long")
    cut = QueryExecutor(Table.write(frame, str(tmp_path_factory.mktemp("cut") / "t"), segments))
    sql = "SELECT k, COUNT(*) AS c, SUM(v) AS s, AVG(v) AS a, COUNT(DISTINCT v) AS d GROUP BY k ORDER BY k"
    assert cut.execute(sql).get_results() == QueryExecutor(Table.from_dataframe(frame)).execute(sql).get_results()


@pytest.mark.parametrize(
    "where, expected",
    [
        ("id = '9007199254740993'", [2]),
        ("id = 9007199254740993", [2]),
        ("id = '9007199254740992.0'", [1]),
        ("id = '9007199254740992.5'", []),
        ("id > '9007199254740992.5'", [2, 3]),
        ("id <> '9007199254740992.5'", [0, 1, 2, 3]),
        ("id = '9223372036854775807'", [3]),
        ("id >= 9223372036854775807", [3]),
        ("id < 9223372036854775808", [0, 1, 2, 3]),
        ("id = '9223372036854775808'", []),
        ("id > '-1e30'", [0, 1, 2, 3]),
        ("id = ' 7 '", [0]),
        ("id = 'seven'", []),
        ("id <> 'seven'", [0, 1, 2, 3]),
        ("id IN (7, '9007199254740993', 'seven', 1.5, 9223372036854775808)", [0, 2]),
        ("NOT id IN (7, '9007199254740993')", [1, 3]),
        ("id IN ('seven')", []),
        ("NOT id IN ('seven')", [0, 1, 2, 3]),
    ],
)
def test_whole_numbers_are_compared_exactly(spark, where, expected):
    frame = spark.createDataFrame([(0, 7), (1, 2**53), (2, 2**53 + 1), (3, 2**63 - 1), (4, None)], "n int, id long")
    assert [r[0] for r in QueryExecutor(Table.from_dataframe(frame)).execute(f"SELECT n WHERE {where} ORDER BY n").get_results()] == expected


def test_sets_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string").write.parquet(str(tmp_path / "t"))
    plan = QueryExecutor(Table.from_data_dir(spark, str(tmp_path / "t"))).dataframe("SELECT id WHERE id IN ('1', 2) AND t IN ('a', 'c')")._jdf.queryExecution().executedPlan().toString()
    assert "In(id, [1,2])" in plan and "In(t, [a,c])" in plan


def test_a_missing_value_is_one_distinct_value(spark):
    frame = spark.createDataFrame([("x", "a"), ("x", None), ("x", None), ("y", "a"), ("y", "b"), ("z", None)], "k string, v string")
    result = QueryExecutor(Table.from_dataframe(frame)).execute("SELECT k, COUNT(DISTINCT v) AS n GROUP BY k ORDER BY k")
    assert result.get_results() == [["x", 2], ["y", 2], ["z", 1]]
