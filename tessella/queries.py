"""Queries over the test tables for the operators of the core, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import dialect_queries
from tessella.operators.keyed import aggregate_by_key, heavy_keys
from tessella.operators.records import MENU_ITEM, load_records
from tessella.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return load_records(table(spark, folder, "menuitem_raw"), keep=["raw_id"]).where("reason IS NOT NULL").select("raw_id", "reason")


def _p1_loaded(spark: SparkSession, folder: str) -> DataFrame:
    loaded = load_records(table(spark, folder, "menuitem_raw"), keep=["raw_id"]).where("reason IS NULL")
    return loaded.select("raw_id", *(F.col(f"record.{f.name}") for f in MENU_ITEM))


def _p1_by_file(spark: SparkSession, folder: str) -> DataFrame:
    rows = load_records(table(spark, folder, "menuitem_raw"), keep=["file_name"])
    return rows.groupBy("file_name", F.coalesce("reason", F.lit("loaded")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


_EDITS = {"n": ("count", None), "n_added": ("count", "added"), "sum_added": ("sum", "added"), "min_added": ("min", "added"), "max_added": ("max", "added"), "avg_added": ("avg", "added"), "sum_deleted": ("sum", "deleted")}


def _p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_keys(table(spark, folder, "wikipedia"), ["channel", "countryName"], 5).select("field_name", "key_value")


def _p3_by(key: str) -> Query:
    return lambda spark, folder: aggregate_by_key(table(spark, folder, "wikipedia"), [key], _EDITS)


def _p3_users_by(key: str) -> Query:
    return lambda spark, folder: aggregate_by_key(table(spark, folder, "wikipedia"), [key], _EDITS, distinct={"n_users": "user"})


_CELL = r'(?:(?:"[^"]*")+|[^",]*)'

_P1_BASE = rf"""
WITH lexed AS (
  SELECT raw_id, file_name, raw,
         regexp_full_match(raw, '(?s){_CELL}(?:,{_CELL})*') AS sound,
         length(regexp_replace(raw, '(?s)"[^"]*"', '', 'g')) - length(replace(regexp_replace(raw, '(?s)"[^"]*"', '', 'g'), ',', '')) + 1 AS cells,
         regexp_extract(raw, '(?s)^({_CELL})', 1) AS id_cell,
         regexp_extract(raw, '(?s)^(?:{_CELL},){{2}}({_CELL})', 1) AS price_cell
  FROM menuitem_raw
), plain AS (
  SELECT *,
         trim(CASE WHEN id_cell LIKE '"%' THEN replace(substr(id_cell, 2, length(id_cell) - 2), '""', '"') ELSE id_cell END, ' ' || chr(9)) AS id_text,
         trim(CASE WHEN price_cell LIKE '"%' THEN replace(substr(price_cell, 2, length(price_cell) - 2), '""', '"') ELSE price_cell END, ' ' || chr(9)) AS price_text
  FROM lexed
), judged AS (
  SELECT raw_id, file_name, id_text, price_text,
         CASE WHEN raw IS NULL THEN 'columns'
              WHEN NOT sound THEN 'quoting'
              WHEN cells <> 9 THEN 'columns'
              WHEN NOT (regexp_full_match(id_text, '[0-9]+') AND length(ltrim(id_text, '0')) BETWEEN 1 AND 19
                        AND (length(ltrim(id_text, '0')) < 19 OR ltrim(id_text, '0') <= '9223372036854775807')) THEN 'id'
              WHEN NOT regexp_full_match(price_text, '|None|nan|[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'price'
         END AS reason
  FROM plain
)"""


def _p1_cell(i: int) -> str:
    """The trimmed text of a field of a record that loads."""
    raw = rf"regexp_extract(raw, '(?s)^(?:{_CELL},){{{{{i}}}}}({_CELL})', 1)".replace("{{", "{").replace("}}", "}")
    return f"""trim(CASE WHEN {raw} LIKE '"%' THEN replace(substr({raw}, 2, length({raw}) - 2), '""', '"') ELSE {raw} END, ' ' || chr(9))"""


def _p1_typed(kind: str, cell: str) -> str:
    if kind == "number":
        number = rf"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
        return f"CASE WHEN {cell} = 'nan' OR regexp_full_match({cell}, '{number}') THEN TRY_CAST(ltrim({cell}, '+') AS DOUBLE) END"
    if kind == "timestamp":
        shape = "[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}( UTC)?"
        return f"CASE WHEN regexp_full_match({cell}, '{shape}') THEN TRY_CAST(substr({cell}, 1, 19) AS TIMESTAMP) END"
    return f"CASE WHEN regexp_full_match({cell}, '[+-]?[0-9]+') THEN TRY_CAST(ltrim({cell}, '+') AS BIGINT) END"


_P1_LOADED = f"""{_P1_BASE}, cells AS (SELECT raw_id, {', '.join(f'{_p1_cell(i)} AS c{i}' for i in range(len(MENU_ITEM)))}
FROM menuitem_raw WHERE raw_id IN (SELECT raw_id FROM judged WHERE reason IS NULL))
SELECT raw_id, {', '.join(f'{_p1_typed(f.kind, f"c{i}")} AS {f.name}' for i, f in enumerate(MENU_ITEM))} FROM cells"""


def _p3_sql(key: str, users: bool = False) -> str:
    more = ', COUNT(DISTINCT "user") AS n_users' if users else ""
    return f"""SELECT "{key}", COUNT(*) AS n, COUNT(added) AS n_added, CAST(SUM(added) AS BIGINT) AS sum_added, MIN(added) AS min_added,
MAX(added) AS max_added, CAST(SUM(added) AS DOUBLE) / COUNT(added) AS avg_added, CAST(SUM(deleted) AS BIGINT) AS sum_deleted{more} FROM wikipedia GROUP BY "{key}\""""


_P3_FOUND = " UNION ALL ".join(
    f"""SELECT '{f}' AS field_name, "{f}" AS key_value FROM wikipedia WHERE "{f}" IS NOT NULL GROUP BY "{f}"
HAVING COUNT(*) * 20 >= (SELECT COUNT("{f}") FROM wikipedia)"""
    for f in ("channel", "countryName")
)


def queries() -> dict[str, Query]:
    return {
        **dialect_queries.queries(),
        "p1_found": _p1_found,
        "p1_loaded": _p1_loaded,
        "p1_by_file": _p1_by_file,
        "p3_found": _p3_found,
        "p3_by_channel": _p3_by("channel"),
        "p3_by_country": _p3_by("countryName"),
        "p3_users_by_channel": _p3_users_by("channel"),
        "p3_users_by_country": _p3_users_by("countryName"),
    }


def oracle_sql() -> dict[str, str]:
    return {
        **dialect_queries.oracle_sql(),
        "p1_found": f"{_P1_BASE} SELECT raw_id, reason FROM judged WHERE reason IS NOT NULL",
        "p1_loaded": _P1_LOADED,
        "p1_by_file": f"{_P1_BASE} SELECT file_name, COALESCE(reason, 'loaded') AS outcome, COUNT(*) AS n FROM judged GROUP BY ALL",
        "p3_found": _P3_FOUND,
        "p3_by_channel": _p3_sql("channel"),
        "p3_by_country": _p3_sql("countryName"),
        "p3_users_by_channel": _p3_sql("channel", True),
        "p3_users_by_country": _p3_sql("countryName", True),
    }
