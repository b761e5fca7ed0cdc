"""Queries in the engine's own dialect over the test tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.executor import QueryExecutor
from tessella.session import scratch_folder, table
from tessella.sources.datasets import dataset
from tessella.streaming.ingest import ingest_available
from tessella.table import Table

Query = Callable[[SparkSession, str], DataFrame]


def _int(column: str) -> str:
    """The whole number of a column, as SQL."""
    return f"CAST(trunc(CASE WHEN {column} IS NULL OR isnan(CAST({column} AS DOUBLE)) THEN 0 ELSE {column} END) AS BIGINT)"


def _sum(expr: str) -> str:
    return f"CAST(SUM({expr}) AS BIGINT)"


#: name: (table, statement in the dialect, SQL)
STATEMENTS: dict[str, tuple[str, str, str]] = {
    # rows
    "scan_star": ("nation", "SELECT * ORDER BY n_nationkey", "SELECT * FROM nation ORDER BY n_nationkey LIMIT 10"),
    "scan_star_mixed": ("region", "SELECT *, r_regionkey + 1 AS next FROM region ORDER BY r_regionkey LIMIT 5", "SELECT *, CAST(r_regionkey AS BIGINT) + 1 AS next FROM region ORDER BY r_regionkey LIMIT 5"),
    "project_literal": ("region", "SELECT r_name, 7 AS seven, 'x' AS mark ORDER BY r_name LIMIT 5", "SELECT r_name, CAST(7 AS BIGINT) AS seven, 'x' AS mark FROM region ORDER BY r_name LIMIT 5"),
    "project_auto_name": ("orders", "SELECT o_orderkey, o_custkey + o_orderkey ORDER BY o_orderkey DESC LIMIT 20", 'SELECT o_orderkey, o_custkey + o_orderkey AS "o_custkey + o_orderkey" FROM orders ORDER BY o_orderkey DESC LIMIT 20'),
    "project_add": (
        "lineitem",
        "SELECT l_orderkey, l_linenumber, l_quantity + l_extendedprice AS v ORDER BY l_quantity + l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10",
        f"SELECT l_orderkey, l_linenumber, {_int('l_quantity')} + {_int('l_extendedprice')} AS v FROM lineitem ORDER BY v DESC, l_orderkey, l_linenumber LIMIT 10",
    ),
    "project_div": (
        "orders",
        "SELECT o_orderkey, o_totalprice / 7 AS v WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100",
        f"SELECT o_orderkey, {_int('o_totalprice')} / CAST(7 AS DOUBLE) AS v FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100",
    ),
    "project_nested_div": (
        "orders",
        "SELECT o_orderkey, o_totalprice / 7 + o_custkey / 2 AS v ORDER BY o_orderkey LIMIT 100",
        f"SELECT o_orderkey, CAST(trunc({_int('o_totalprice')} / CAST(7 AS DOUBLE)) AS BIGINT) + CAST(trunc(o_custkey / CAST(2 AS DOUBLE)) AS BIGINT) AS v FROM orders ORDER BY o_orderkey LIMIT 100",
    ),
    "project_sub_mul": ("part", "SELECT p_partkey, p_size * 3 - 1 AS v ORDER BY p_partkey LIMIT 50", "SELECT p_partkey, CAST(p_size AS BIGINT) * 3 - 1 AS v FROM part ORDER BY p_partkey LIMIT 50"),
    "order_mixed": ("customer", "SELECT c_mktsegment, c_custkey ORDER BY c_mktsegment DESC, c_custkey LIMIT 25", "SELECT c_mktsegment, c_custkey FROM customer ORDER BY c_mktsegment DESC, c_custkey LIMIT 25"),
    "order_alias": ("part", "SELECT p_partkey, p_size + p_partkey AS v ORDER BY v DESC LIMIT 5", "SELECT p_partkey, CAST(p_size AS BIGINT) + p_partkey AS v FROM part ORDER BY v DESC LIMIT 5"),
    "limit_implicit": ("supplier", "SELECT s_suppkey ORDER BY s_suppkey", "SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 10"),
    "limit_zero": ("supplier", "SELECT s_suppkey ORDER BY s_suppkey DESC LIMIT 0", "SELECT s_suppkey FROM supplier ORDER BY s_suppkey DESC LIMIT 10"),
    "rows_edits": (
        "wikipedia",
        "SELECT edit_id, cityName, added WHERE countryName = 'Saeltziarkos' AND isRobot = 'False' ORDER BY edit_id, added DESC LIMIT 200",
        "SELECT edit_id, \"cityName\", added FROM wikipedia WHERE \"countryName\" = 'Saeltziarkos' AND NOT \"isRobot\" ORDER BY edit_id, added DESC NULLS LAST LIMIT 200",
    ),
    # filters
    "filter_eq": ("orders", "SELECT COUNT(*) AS c WHERE o_orderstatus = 'F'", "SELECT COUNT(*) AS c FROM orders WHERE o_orderstatus = 'F'"),
    "filter_mirrored": ("orders", "SELECT COUNT(*) AS c WHERE 'F' = o_orderstatus", "SELECT COUNT(*) AS c FROM orders WHERE 'F' = o_orderstatus"),
    "filter_and_or": (
        "lineitem",
        "SELECT COUNT(*) AS c WHERE l_linestatus = 'F' AND (l_returnflag = 'R' OR l_returnflag = 'A')",
        "SELECT COUNT(*) AS c FROM lineitem WHERE l_linestatus = 'F' AND (l_returnflag = 'R' OR l_returnflag = 'A')",
    ),
    "filter_const_true": ("nation", "SELECT COUNT(*) AS c WHERE 'a' = 'a'", "SELECT COUNT(*) AS c FROM nation"),
    "filter_const_false": ("nation", "SELECT n_name WHERE 1 = 2", "SELECT n_name FROM nation WHERE 1 = 2"),
    "filter_absent": ("events", "SELECT event_id WHERE event_type = 'nope'", "SELECT event_id FROM events WHERE event_type = 'nope'"),
    "filter_number": ("lineitem", "SELECT COUNT(*) AS c WHERE l_linenumber = 5", "SELECT COUNT(*) AS c FROM lineitem WHERE l_linenumber = 5"),
    "filter_number_text": ("menuitem", "SELECT COUNT(id) AS c WHERE price = '0.25'", "SELECT COUNT(*) AS c FROM menuitem WHERE price = 0.25"),
    "filter_columns": ("menuitem", "SELECT COUNT(*) AS c WHERE created_at = updated_at", "SELECT COUNT(*) AS c FROM menuitem WHERE created_at = updated_at"),
    "filter_range": (
        "orders",
        "SELECT COUNT(*) AS c WHERE o_totalprice > 1000.5 AND o_custkey <= 500 AND o_orderstatus <> 'O'",
        "SELECT COUNT(*) AS c FROM orders WHERE o_totalprice > 1000.5 AND o_custkey <= 500 AND o_orderstatus <> 'O'",
    ),
    "filter_in_between_like": (
        "part",
        "SELECT COUNT(*) AS c WHERE p_size IN (1, 5, 9) OR p_size BETWEEN 20 AND 30 AND NOT p_brand LIKE '%1'",
        "SELECT COUNT(*) AS c FROM part WHERE p_size IN (1, 5, 9) OR p_size BETWEEN 20 AND 30 AND NOT p_brand LIKE '%1'",
    ),
    "filter_null": ("wikipedia", "SELECT COUNT(*) AS c WHERE cityName IS NULL AND countryName IS NOT NULL", 'SELECT COUNT(*) AS c FROM wikipedia WHERE "cityName" IS NULL AND "countryName" IS NOT NULL'),
    # aggregates
    "count_star": ("lineitem", "SELECT COUNT(*) AS c", "SELECT COUNT(*) AS c FROM lineitem"),
    "count_rows_with_null": ("menuitem", "SELECT COUNT(high_price) AS c", "SELECT COUNT(*) AS c FROM menuitem"),
    "count_distinct": ("events", "SELECT event_type, COUNT(DISTINCT user_id) AS u GROUP BY event_type", "SELECT event_type, COUNT(DISTINCT user_id) AS u FROM events GROUP BY event_type"),
    "count_distinct_with_null": (
        "wikipedia",
        "SELECT channel, COUNT(DISTINCT cityName) AS n GROUP BY channel",
        'SELECT channel, COUNT(DISTINCT "cityName") + MAX(CASE WHEN "cityName" IS NULL THEN 1 ELSE 0 END) AS n FROM wikipedia GROUP BY channel',
    ),
    "count_distinct_of_key": ("wikipedia", "SELECT channel, COUNT(DISTINCT channel) AS one GROUP BY channel", "SELECT channel, COUNT(DISTINCT channel) AS one FROM wikipedia GROUP BY channel"),
    "agg_multi": (
        "events",
        "SELECT event_type, COUNT(event_id) AS c, SUM(value) AS s, AVG(value) AS a GROUP BY event_type",
        f"SELECT event_type, COUNT(*) AS c, {_sum(_int('value'))} AS s, AVG({_int('value')}) AS a FROM events GROUP BY event_type",
    ),
    "agg_nulls_as_zero": (
        "menuitem",
        "SELECT dish_id, COUNT(price) AS c, SUM(price) AS s, AVG(price) AS a GROUP BY dish_id",
        f"SELECT dish_id, COUNT(*) AS c, {_sum(_int('price'))} AS s, AVG({_int('price')}) AS a FROM menuitem GROUP BY dish_id",
    ),
    "agg_avg": ("lineitem", "SELECT AVG(l_extendedprice) AS a", f"SELECT AVG({_int('l_extendedprice')}) AS a FROM lineitem"),
    "agg_of_key": ("part", "SELECT p_size, SUM(p_size) AS s GROUP BY p_size", f"SELECT p_size, {_sum('p_size')} AS s FROM part GROUP BY p_size"),
    "empty_global": ("events", "SELECT COUNT(*) AS c, SUM(value) AS s WHERE event_type = 'nope'", "SELECT COUNT(*) AS c, CAST(SUM(1) AS BIGINT) AS s FROM events WHERE event_type = 'nope' HAVING COUNT(*) > 0"),
    "groupby_nofunc": ("orders", "SELECT o_orderstatus, o_orderpriority GROUP BY o_orderstatus, o_orderpriority", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "sum_expr": (
        "lineitem",
        "SELECT l_returnflag, SUM(l_quantity + l_extendedprice) AS s GROUP BY l_returnflag",
        f"SELECT l_returnflag, {_sum(_int('l_quantity') + ' + ' + _int('l_extendedprice'))} AS s FROM lineitem GROUP BY l_returnflag",
    ),
    "post_agg": (
        "lineitem",
        "SELECT l_returnflag, SUM(l_linenumber) / COUNT(*) AS r, COUNT(*) + COUNT(DISTINCT l_suppkey) AS z GROUP BY l_returnflag",
        "SELECT l_returnflag, CAST(SUM(l_linenumber) AS DOUBLE) / COUNT(*) AS r, COUNT(*) + COUNT(DISTINCT l_suppkey) AS z FROM lineitem GROUP BY l_returnflag",
    ),
    "agg_auto_names": (
        "orders",
        "SELECT o_orderstatus, COUNT(o_orderkey), SUM(o_custkey) GROUP BY o_orderstatus",
        'SELECT o_orderstatus, COUNT(*) AS "COUNT(o_orderkey)", CAST(SUM(o_custkey) AS BIGINT) AS "SUM(o_custkey)" FROM orders GROUP BY o_orderstatus',
    ),
    "agg_shared": (
        "orders",
        "SELECT o_orderpriority, COUNT(*) AS c, COUNT(*) + COUNT(*) AS twice GROUP BY o_orderpriority ORDER BY COUNT(*) DESC",
        "SELECT o_orderpriority, COUNT(*) AS c, 2 * COUNT(*) AS twice FROM orders GROUP BY o_orderpriority",
    ),
    "topk_groups": ("orders", "SELECT o_custkey, COUNT(*) AS c GROUP BY o_custkey ORDER BY COUNT(*) DESC LIMIT 10", "SELECT o_custkey, COUNT(*) AS c FROM orders GROUP BY o_custkey ORDER BY c DESC, o_custkey LIMIT 10"),
    "order_hidden_agg": ("part", "SELECT p_brand GROUP BY p_brand ORDER BY SUM(p_size) DESC LIMIT 5", "SELECT p_brand FROM part GROUP BY p_brand ORDER BY SUM(p_size) DESC, p_brand LIMIT 5"),
    "order_group_asc": ("part", "SELECT p_brand, COUNT(*) AS c GROUP BY p_brand ORDER BY p_brand LIMIT 5", "SELECT p_brand, COUNT(*) AS c FROM part GROUP BY p_brand ORDER BY p_brand LIMIT 5"),
    "order_groups_implicit_limit": ("events", "SELECT user_id, COUNT(*) AS c GROUP BY user_id ORDER BY user_id", "SELECT user_id, COUNT(*) AS c FROM events GROUP BY user_id ORDER BY user_id LIMIT 1000"),
    "order_many_groups_implicit_limit": ("orders", "SELECT o_orderkey, COUNT(*) AS c GROUP BY o_orderkey ORDER BY o_orderkey DESC", "SELECT o_orderkey, COUNT(*) AS c FROM orders GROUP BY o_orderkey ORDER BY o_orderkey DESC LIMIT 1000"),
    "min_max": ("orders", "SELECT o_orderstatus, MIN(o_orderdate) AS first, MAX(o_totalprice) AS most GROUP BY o_orderstatus", "SELECT o_orderstatus, MIN(o_orderdate) AS first, MAX(o_totalprice) AS most FROM orders GROUP BY o_orderstatus"),
    "sum_distinct": ("part", "SELECT p_brand, SUM(DISTINCT p_size) AS s, AVG(DISTINCT p_size) AS a GROUP BY p_brand", "SELECT p_brand, CAST(SUM(DISTINCT p_size) AS BIGINT) AS s, AVG(DISTINCT p_size) AS a FROM part GROUP BY p_brand"),
    "having": ("wikipedia", "SELECT user, COUNT(*) AS c GROUP BY user HAVING COUNT(*) > 20 AND c < 1000", 'SELECT "user", COUNT(*) AS c FROM wikipedia GROUP BY "user" HAVING COUNT(*) > 20 AND COUNT(*) < 1000'),
    "select_distinct": ("wikipedia", "SELECT DISTINCT channel, namespace", "SELECT DISTINCT channel, namespace FROM wikipedia"),
    "edits_by_city": (
        "wikipedia",
        "SELECT cityName, SUM(added) AS s, COUNT(*) AS c WHERE countryName = 'Saeltziarkos' OR countryName = 'nowhere' GROUP BY cityName",
        f"SELECT \"cityName\", {_sum(_int('added'))} AS s, COUNT(*) AS c FROM wikipedia WHERE \"countryName\" = 'Saeltziarkos' GROUP BY \"cityName\"",
    ),
    # the published timings' statements
    "menu_count": ("menuitem", "SELECT COUNT(id) AS c", "SELECT COUNT(*) AS c FROM menuitem"),
    "menu_count_by_page": ("menuitem", "SELECT menu_page_id, COUNT(id) AS c GROUP BY menu_page_id", "SELECT menu_page_id, COUNT(*) AS c FROM menuitem GROUP BY menu_page_id"),
    "menu_price_count": ("menuitem", "SELECT COUNT(id) AS c WHERE price = '0.25'", "SELECT COUNT(*) AS c FROM menuitem WHERE price = 0.25"),
    "menu_dish_count": ("menuitem", "SELECT COUNT(menu_page_id) AS c WHERE dish_id = '1'", "SELECT COUNT(*) AS c FROM menuitem WHERE dish_id = 1 HAVING COUNT(*) > 0"),
    "menu_price_by_page": (
        "menuitem",
        "SELECT menu_page_id, COUNT(price) AS c, SUM(price) AS s, AVG(price) AS a GROUP BY menu_page_id",
        f"SELECT menu_page_id, COUNT(*) AS c, {_sum(_int('price'))} AS s, AVG({_int('price')}) AS a FROM menuitem GROUP BY menu_page_id",
    ),
    "menu_top_pages": (
        "menuitem",
        "SELECT menu_page_id, COUNT(id) AS c GROUP BY menu_page_id ORDER BY COUNT(id) DESC LIMIT 10",
        "SELECT menu_page_id, COUNT(*) AS c FROM menuitem GROUP BY menu_page_id ORDER BY c DESC, menu_page_id NULLS FIRST LIMIT 10",
    ),
}

_GENRES = 'SELECT Genre, COUNT(*) AS c, SUM("Albums Sold (millions)") AS s, COUNT(DISTINCT Nationality) AS n GROUP BY Genre'
_GENRES_SQL = """SELECT coalesce("Genre", '{0}') AS "Genre", COUNT(*) AS c, CAST(SUM(coalesce("Albums Sold (millions)", 0)) AS BIGINT) AS s,
COUNT(DISTINCT coalesce("Nationality", '{0}')) AS n FROM artists GROUP BY 1"""


def _statement(name: str) -> Query:
    source, text, _ = STATEMENTS[name]
    return lambda spark, folder: QueryExecutor(Table.from_dataframe(table(spark, folder, source))).dataframe(text)


def _written(spark: SparkSession, frame: DataFrame, kind: str) -> str:
    """A file folder of the given kind with the rows of a table, as it would come from elsewhere."""
    if kind in ("csv", "tsv"):
        path = f"{scratch_folder(spark, 'source')}.{kind}"
        frame.write.option("header", True).option("sep", "," if kind == "csv" else "\t").option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)
        return path
    path = f"{scratch_folder(spark, 'source')}.{'ndjson' if kind == 'ndjson' else 'json'}"
    if kind in ("ndjson", "json_lines"):
        frame.write.option("ignoreNullFields", kind == "ndjson").json(path)
        return path
    each = F.to_json(F.struct(*(F.col(f"`{c}`") for c in frame.columns)), {"ignoreNullFields": "false"})
    one = frame.select(each.alias("value"))
    if kind == "json_array":  # one array over many lines
        one = one.agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("value"), ",\n"), F.lit("\n]")).alias("value"))
    one.coalesce(1).write.text(path)
    return path


def _ingested(kind: str, segments: int) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        source = _written(spark, dataset(spark, folder, "artists"), kind)
        return QueryExecutor(Table.from_ingest_source(spark, scratch_folder(spark, "table"), source, segments)).dataframe(_GENRES)

    return run


def _ingested_object(spark: SparkSession, folder: str) -> DataFrame:
    """A file that holds a single object, with numbers and a truth value that become texts."""
    artists = dataset(spark, folder, "artists")
    one = artists.agg(F.min("Name").alias("first"), F.count(F.lit(1)).alias("n"), F.lit(True).alias("known"), F.lit(None).cast("string").alias("none"))
    stored = Table.from_ingest_source(spark, scratch_folder(spark, "table"), _written(spark, one, "json_object"))
    return QueryExecutor(stored).dataframe("SELECT first, n, known, none WHERE known = 'True'")


def _segment_ties(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that tie are given by segment, and within one the later row first."""
    stored = Table.write(table(spark, folder, "part"), scratch_folder(spark, "segments"), 5)
    return QueryExecutor(stored).dataframe("SELECT p_partkey, p_size ORDER BY p_size LIMIT 75")


def _unordered_limit(spark: SparkSession, folder: str) -> DataFrame:
    """Any five groups, each with its right count."""
    part = table(spark, folder, "part")
    some = QueryExecutor(Table.from_dataframe(part)).dataframe("SELECT p_brand, COUNT(*) AS c GROUP BY p_brand LIMIT 5")
    right = part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("c"))
    return some.join(right, ["p_brand", "c"], "left_semi").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_brand").alias("n_brands"))


def _approximate(spark: SparkSession, folder: str) -> DataFrame:
    """Approximate distinct counts, each within three of its standard errors (5 %) of the exact one."""
    events = Table.from_dataframe(table(spark, folder, "events"))
    frame = QueryExecutor(events).dataframe("SELECT event_type, APPROX_COUNT_DISTINCT(user_id) AS u, COUNT(DISTINCT user_id) AS n GROUP BY event_type")
    return frame.select("event_type", "n", (F.abs(F.col("u") - F.col("n")) <= 0.15 * F.col("n")).alias("within"))


def _big_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Whole numbers beyond those that a double can tell apart."""
    orders = table(spark, folder, "orders").select((F.col("o_orderkey") + F.lit(2**53)).alias("id"))
    text = """SELECT id WHERE id = '9007199254740995' OR id IN ('9007199254740997', 9007199254740998, 1.5, 'x', '9223372036854775808')
    OR id < '9007199254740993.5' AND id <= 9223372036854775808 OR id = '9223372036854775807' ORDER BY id LIMIT 100"""
    return QueryExecutor(Table.from_dataframe(orders)).dataframe(text)


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows each of seven segments of a table holds."""
    stored = Table.write(table(spark, folder, "menuitem"), scratch_folder(spark, "segments"), 7)
    return stored.frame.groupBy(F.col("_segment").cast("long").alias("segment")).agg(F.count(F.lit(1)).alias("n"))


def _segmented(spark: SparkSession, folder: str) -> DataFrame:
    stored = Table.write(table(spark, folder, "menuitem"), scratch_folder(spark, "segments"), 11)
    return QueryExecutor(stored).dataframe(STATEMENTS["menu_price_by_page"][1])


def _lexicographic(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("string").alias("p_size"))
    return QueryExecutor(Table.from_dataframe(part)).dataframe("SELECT p_partkey, p_size AS s ORDER BY p_size DESC, p_partkey LIMIT 10")


def _exact(spark: SparkSession, folder: str) -> DataFrame:
    return QueryExecutor(Table.from_dataframe(table(spark, folder, "orders")), numeric="exact").dataframe("SELECT o_orderstatus, COUNT(*) AS c, MAX(o_totalprice / 2) AS half GROUP BY o_orderstatus")


def _appended(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark, "appended")
    artists = table(spark, folder, "artists")
    both = Table.write(artists, path, 2).append(artists, path)
    return QueryExecutor(both).dataframe('SELECT Nationality, COUNT(*) AS c, SUM("Awards Won") AS s GROUP BY Nationality')


def _streamed(spark: SparkSession, folder: str) -> DataFrame:
    """Files of edits that are taken into a table as they are found, then queried."""
    path = scratch_folder(spark, "streamed")
    edits = table(spark, folder, "wikipedia").select("edit_id", "channel", "added")
    incoming = scratch_folder(spark, "incoming")
    edits.write.parquet(incoming)
    stored = ingest_available(spark, incoming, edits.schema, path, scratch_folder(spark, "progress"))
    return QueryExecutor(stored).dataframe("SELECT channel, COUNT(*) AS c, SUM(added) AS s GROUP BY channel")


def _streamed_after(spark: SparkSession, folder: str) -> DataFrame:
    """Files taken into a table that had segments before."""
    path, incoming = scratch_folder(spark, "streamed"), scratch_folder(spark, "incoming")
    edits = table(spark, folder, "wikipedia").select("edit_id", "channel", "added")
    Table.write(edits, path, 3)
    edits.write.parquet(incoming)
    for _ in range(2):  # the second time there is nothing new
        stored = ingest_available(spark, incoming, edits.schema, path, f"{path}-progress")
    return QueryExecutor(stored).dataframe("SELECT channel, COUNT(*) AS c, SUM(added) AS s GROUP BY channel")


#: Statements over `nation` that are refused, by what is wrong with them.
REFUSED = {
    "unknown column": "SELECT nowhere",
    "column of neither kind": "SELECT n_name, COUNT(*) AS c GROUP BY n_regionkey",
    "nested aggregates": "SELECT SUM(COUNT(n_name)) AS s",
    "unknown function": "SELECT UPPER(n_name)",
    "join": "SELECT n_name FROM nation JOIN region",
    "two tables": "SELECT n_name FROM nation, region",
    "set operation": "SELECT n_name UNION SELECT n_name",
    "subquery": "SELECT n_name WHERE n_regionkey IN (SELECT r_regionkey FROM region)",
    "window": "SELECT COUNT(*) OVER (PARTITION BY n_regionkey) AS c",
    "offset": "SELECT n_name ORDER BY n_name LIMIT 5 OFFSET 5",
    "common table": "WITH a AS (SELECT n_name) SELECT n_name FROM a",
    "aggregate in WHERE": "SELECT n_name WHERE COUNT(*) > 1",
}


def _refused(spark: SparkSession, folder: str) -> DataFrame:
    """Which of the statements that the dialect does not have are refused when they are planned."""
    executor = QueryExecutor(Table.from_dataframe(table(spark, folder, "nation")))

    def refused(statement: str) -> bool:
        try:
            executor.dataframe(statement)
        except (ValueError, NotImplementedError):
            return True
        return False

    return spark.createDataFrame([(what, refused(statement)) for what, statement in REFUSED.items()], "what string, refused boolean")


def queries() -> dict[str, Query]:
    return {
        **{name: _statement(name) for name in STATEMENTS},
        "order_lexicographic": _lexicographic,
        "numeric_exact": _exact,
        "ingest_csv": _ingested("csv", 3),
        "ingest_tsv": _ingested("tsv", 1),
        "ingest_json": _ingested("json_array", 2),
        "ingest_json_lines": _ingested("json_lines", 2),
        "ingest_json_object": _ingested_object,
        "ingest_ndjson": _ingested("ndjson", 11),
        "segment_sizes": _segments,
        "segment_aggregate": _segmented,
        "append_segment": _appended,
        "ingest_stream": _streamed,
        "ingest_stream_existing": _streamed_after,
        "segment_ties": _segment_ties,
        "agg_limit_no_order": _unordered_limit,
        "approx_distinct": _approximate,
        "filter_big_number": _big_numbers,
        "refused_statements": _refused,
    }


def oracle_sql() -> dict[str, str]:
    artists = {kind: _GENRES_SQL.format(missing) for kind, missing in (("csv", ""), ("tsv", ""), ("json", "None"), ("json_lines", "None"), ("ndjson", "None"))}
    return {
        **{name: sql for name, (_, _, sql) in STATEMENTS.items() if sql},
        "order_lexicographic": "SELECT p_partkey, CAST(p_size AS VARCHAR) AS s FROM part ORDER BY s DESC, p_partkey LIMIT 10",
        "numeric_exact": "SELECT o_orderstatus, COUNT(*) AS c, MAX(o_totalprice / 2) AS half FROM orders GROUP BY o_orderstatus",
        **{f"ingest_{kind}": sql for kind, sql in artists.items()},
        "ingest_json_object": """SELECT MIN("Name") AS first, CAST(COUNT(*) AS VARCHAR) AS n, 'True' AS known, 'None' AS none FROM artists""",
        "ingest_stream_existing": f"SELECT channel, 2 * COUNT(*) AS c, CAST(2 * SUM({_int('added')}) AS BIGINT) AS s FROM wikipedia GROUP BY channel",
        "segment_ties": """SELECT p_partkey, p_size FROM (SELECT *, row_number() OVER () - 1 AS i FROM part)
ORDER BY p_size, i // CAST(ceil((SELECT COUNT(*) FROM part) / 5.0) AS BIGINT), i DESC LIMIT 75""",
        "agg_limit_no_order": "SELECT LEAST(5, COUNT(DISTINCT p_brand)) AS n, LEAST(5, COUNT(DISTINCT p_brand)) AS n_brands FROM part",
        "approx_distinct": "SELECT event_type, COUNT(DISTINCT user_id) AS n, TRUE AS within FROM events GROUP BY event_type",
        "filter_big_number": """SELECT id FROM (SELECT o_orderkey + 9007199254740992 AS id FROM orders) WHERE id IN (9007199254740995, 9007199254740997, 9007199254740998)
OR id <= 9007199254740993 ORDER BY id LIMIT 100""",
        "refused_statements": " UNION ALL ".join(f"SELECT '{what}' AS what, TRUE AS refused" for what in REFUSED),
        "segment_sizes": """SELECT segment, COUNT(*) AS n FROM (SELECT CAST((row_number() OVER () - 1) // CAST(ceil((SELECT COUNT(*) FROM menuitem) / 7.0) AS BIGINT) AS BIGINT) AS segment
FROM menuitem) GROUP BY segment""",
        "segment_aggregate": STATEMENTS["menu_price_by_page"][2],
        "append_segment": 'SELECT "Nationality", 2 * COUNT(*) AS c, CAST(2 * SUM(coalesce("Awards Won", 0)) AS BIGINT) AS s FROM artists GROUP BY "Nationality"',
        "ingest_stream": f"SELECT channel, COUNT(*) AS c, {_sum(_int('added'))} AS s FROM wikipedia GROUP BY channel",
    }
