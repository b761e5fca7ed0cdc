"""The two readings of a value: as a dimension's text, and as a whole number in arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_int(column: Column, kind: T.DataType) -> Column:
    """A whole number for sums, averages and arithmetic: truncated toward zero, and 0 for null, blank, ``None`` and NaN.

    Text that is no number is an error, so that a mistaken column is noticed.
    """
    if isinstance(kind, T.StringType):
        text = F.trim(column)
        number = text.cast("double")
        void = text.isNull() | text.isin("", "None", "nan", "NaN")
        return F.when(void, F.lit(0)).otherwise(number.cast("bigint")).cast("bigint")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(column.isNull() | F.isnan(column), F.lit(0)).otherwise(column.cast("bigint")).cast("bigint")
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.coalesce(column.cast("bigint"), F.lit(0).cast("bigint"))
    raise ValueError(f"no whole number can be made of {kind.simpleString()}")


def to_number(column: Column, kind: T.DataType) -> Column:
    """As :func:`to_int`, without truncation."""
    if isinstance(kind, T.StringType):
        text = F.trim(column)
        return F.when(text.isNull() | text.isin("", "None", "nan", "NaN"), F.lit(0.0)).otherwise(text.cast("double"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(column.isNull() | F.isnan(column), F.lit(0.0)).otherwise(column.cast("double"))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.coalesce(column.cast("bigint") if not isinstance(kind, T.DecimalType) else column, F.lit(0))
    raise ValueError(f"no number can be made of {kind.simpleString()}")


def dimension_string(column: Column, kind: T.DataType, missing: str = "None") -> Column:
    """The text under which a value is stored in a table of dimensions."""
    if isinstance(kind, T.BooleanType):
        text = F.initcap(column.cast("string"))
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        text = F.to_json(column)
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit(missing))
