"""Running statements: the entry point of the library."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tessella.plans.parser import parse
from tessella.plans.planner import Planner
from tessella.session import apply_semantics
from tessella.table import Table


@dataclass
class ResultSet:
    """A finished result: column names and rows as lists."""

    columns: list[str]
    results: list[list]

    def get_results(self) -> list[list]:
        return self.results

    def __len__(self) -> int:
        return len(self.results)


class QueryExecutor:
    """Executes statements over one table.

    The session is set to tell names' cases apart, to be strict about casts and to use UTC.
    Numbers are whole in sums, averages and arithmetic; ``numeric="exact"`` keeps fractions.
    """

    def __init__(self, table: Table, numeric: str = "trunc"):
        if numeric not in ("trunc", "exact"):
            raise ValueError("numeric is either 'trunc' or 'exact'")
        apply_semantics(table.frame.sparkSession)
        self.table = table
        self.planner = Planner(table, numeric == "exact")

    @classmethod
    def from_data_dir(cls, spark: SparkSession, path: str, numeric: str = "trunc") -> QueryExecutor:
        return cls(Table.from_data_dir(spark, path), numeric)

    @classmethod
    def from_ingest_source(cls, spark: SparkSession, path: str, source: str, numeric: str = "trunc") -> QueryExecutor:
        return cls(Table.from_ingest_source(spark, path, source), numeric)

    def dataframe(self, sql: str) -> DataFrame:
        """The statement's plan, not yet run; row queries without LIMIT give 10 rows, ordered aggregates 1000."""
        return self.planner.plan(parse(sql))

    def execute(self, sql: str) -> ResultSet:
        """Run a statement and fetch its rows, whose number its LIMIT or its groups bound."""
        frame = self.dataframe(sql)
        return ResultSet(frame.columns, [list(row) for row in frame.collect()])
