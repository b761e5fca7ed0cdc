"""Aggregates per key that stay even when a few keys hold most of the records.

Every aggregate here is algebraic: each task folds its rows into one small state per
key in Spark's own hash table (which falls back to sorting and spilling when it is
full), and only those states are shuffled. A key that holds a third of all rows then
sends one state per task, not a third of the rows. Exact distinct counts go through
one more level, keyed by (key, value), which spreads a hot key over all tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _partial(name: str, kind: str, column: str | None) -> list[Column]:
    value = F.lit(1) if column is None else F.col(f"`{column}`")
    if kind == "count":
        return [F.count(value).alias(f"{name}__n")]
    if kind == "sum":
        return [F.sum(value).alias(f"{name}__s")]
    if kind == "avg":
        return [F.sum(value).alias(f"{name}__s"), F.count(value).alias(f"{name}__n")]
    if kind in ("min", "max"):
        return [getattr(F, kind)(value).alias(f"{name}__m")]
    raise ValueError(f"not an algebraic aggregate: {kind}")


def _merge(name: str, kind: str) -> Column:
    if kind == "count":
        return F.sum(f"`{name}__n`").alias(name)
    if kind == "sum":
        return F.sum(f"`{name}__s`").alias(name)
    if kind == "avg":
        return F.try_divide(F.sum(f"`{name}__s`").cast("double"), F.sum(f"`{name}__n`")).alias(name)
    return getattr(F, kind)(f"`{name}__m`").alias(name)


def aggregate_by_key(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: Mapping[str, tuple[str, str | None]],
    distinct: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per combination of ``keys`` with all ``aggregates`` over every row.

    ``aggregates`` maps an output name to (kind, column), kind being count, sum, avg,
    min or max and column None for a count of rows. ``distinct`` maps at most one
    output name to the column whose distinct values are counted exactly. Null keys
    form a group of their own; null values are passed over as in SQL; an empty table
    gives no rows; columns not named are never read.
    """
    distinct = dict(distinct or {})
    if len(distinct) > 1:
        raise ValueError("count one column's distinct values at a time")
    by = [F.col(f"`{k}`") for k in keys]
    if not distinct:
        native = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
        for kind, _ in aggregates.values():
            if kind not in native:
                raise ValueError(f"not an algebraic aggregate: {kind}")
        return df.groupBy(*by).agg(
            *(native[kind](F.lit(1) if c is None else F.col(f"`{c}`")).alias(name) for name, (kind, c) in aggregates.items())
        )
    (name, column), = distinct.items()
    level = [c for out, (kind, col) in aggregates.items() for c in _partial(out, kind, col)]
    # keys are renamed so that a key may also be the counted column or share an output's name
    pairs = df.groupBy(*(k.alias(f"__k{i}") for i, k in enumerate(by)), F.col(f"`{column}`").alias("__value")).agg(
        *level or [F.count(F.lit(1)).alias("__rows")]
    )
    return (
        pairs.groupBy(*(f"__k{i}" for i in range(len(keys))))
        .agg(*(_merge(out, kind) for out, (kind, _) in aggregates.items()), F.count("__value").alias(name))
        .withColumnsRenamed({f"__k{i}": k for i, k in enumerate(keys)})
    )


def heavy_keys(df: DataFrame, fields: Sequence[str], min_percent: int) -> DataFrame:
    """(field_name, key_value, n): the values that stand in at least ``min_percent`` % of a field's non-null rows.

    All fields are counted in one scan. Values come out as strings, as stored; nulls
    take no part; repeated rows count each time; an empty table gives no rows. At most
    100 / ``min_percent`` values of a field can qualify.
    """
    each = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").cast("string").alias("key_value")) for f in fields))
    counts = (
        df.select(F.inline(each))
        .where(F.col("key_value").isNotNull())
        .groupBy("field_name", "key_value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # one row per field, so the size of the broadcast is known; the counts' shuffle is reused
    totals = counts.groupBy("field_name").agg(F.sum("n").alias("total"))
    return (
        counts.join(F.broadcast(totals), "field_name")
        .where(F.col("n") * 100 >= F.col("total") * min_percent)
        .select("field_name", "key_value", "n")
    )
