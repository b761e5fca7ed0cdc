"""Spark-first analytics over segmented single tables, plus data-preparation operators for very large inputs."""

from tessella.executor import QueryExecutor, ResultSet
from tessella.table import Table

__all__ = ["QueryExecutor", "ResultSet", "Table"]
__version__ = "0.1.0"
