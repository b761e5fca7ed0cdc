"""Named example tables, read from a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.session import table

DATASETS = {"wikipedia": "wikipedia", "menuitem": "menuitem", "artists": "artists"}
ALIASES = {"wiki": "wikipedia", "menu": "menuitem", "menus": "menuitem"}


def dataset(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table of a name or alias."""
    known = ALIASES.get(name, name)
    if known not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(sorted(DATASETS))}")
    return table(spark, folder, DATASETS[known])
