"""The most frequent values of a column, exactly and in bounded memory.

A value's count is at most that of any prefix of its hash. Prefixes of the hash are
counted first; only those that could still hold a value above the lower bound are
kept and lengthened, and only rows under the prefixes that remain at the end are
counted by full value. The bound is a share of all rows, or the k-th highest true
count among the values under the k fullest prefixes. Each step is a native aggregate
over one column, so what is shuffled are partial counts and never rows; the prefixes
of a step reach the driver, and the next step as a filter, only if they are few.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of the first prefixes, which the driver sees: at most 2**16 counts.
FIRST_BITS = 16
#: As many retained prefixes are written into the filter itself; more are joined.
LITERALS = 300
#: As many prefixes make a filter; where more could hold a value above the bound, a step prunes too little to be worth it.
KEPT = 1 << 18


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("v"), 64 - bits)


def _counted(rows: DataFrame, key: Column, name: str) -> DataFrame:
    return rows.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def _under(rows: DataFrame, prefixes: Sequence[int], bits: int) -> DataFrame:
    """The rows whose hash begins with one of at most ``KEPT`` prefixes."""
    if len(prefixes) <= LITERALS:
        return rows.where(_prefix(bits).isin(list(prefixes)))
    held = rows.sparkSession.createDataFrame(pa.table({"p": pa.array(prefixes, pa.int64())}))  # 2 MB at most
    return rows.join(F.broadcast(held), _prefix(bits) == F.col("p"), "left_semi")


def frequent_values(
    df: DataFrame, column: str, k: int | None = None, min_share: tuple[int, int] | None = None, longer: Sequence[int] = (32,)
) -> DataFrame:
    """(value, n): the ``k`` most frequent values, or all that stand in at least ``min_share`` of the non-null rows.

    ``min_share`` is a fraction (numerator, denominator). Counts are exact. All rows
    count, repeated ones too; nulls take no part, NaN is a value, and 0.0 and -0.0 are
    one. Ties for the last of ``k`` places go to the smaller value. An empty table or
    one of nulls alone gives no rows. With ``min_share`` no more than denominator /
    numerator prefixes can reach the bound, with ``k`` all whose count reaches the k-th
    best known one; a step that would keep more than ``KEPT`` is passed over. ``longer`` are
    the bits of the steps between the first prefixes and full values; beyond some
    thousand million different values (32, 48) prunes better.
    """
    if (k is None) == (min_share is None):
        raise ValueError("give either k or min_share")
    value = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        value = F.when(value == 0, F.lit(0.0)).when(F.isnan(value), F.lit(float("nan"))).otherwise(value)
    rows = df.select(value.alias("v")).where(F.col("v").isNotNull())
    first = _counted(rows, _prefix(FIRST_BITS), "p").toArrow()  # at most 2**16 rows
    prefix, times = (first.column(c).to_numpy() for c in ("p", "n"))
    if min_share is not None:
        of, whole = min_share
        least = max(1, -(-int(times.sum()) * of // whole))
    else:
        fullest = prefix[np.lexsort((prefix, -times))[:k]].tolist()
        best = _counted(_under(rows, fullest, FIRST_BITS), F.col("v"), "value").orderBy(F.desc("n")).limit(k)
        known, last = best.agg(F.count(F.lit(1)), F.min("n")).first()
        least = last if known == k else 1
    rows = _under(rows, prefix[times >= least].tolist(), FIRST_BITS)
    for bits in longer:
        kept = _counted(rows, _prefix(bits), "p").where(F.col("n") >= least).select("p").limit(KEPT + 1).toArrow().column("p").to_pylist()
        if len(kept) <= KEPT:
            rows = _under(rows, kept, bits)
    counts = _counted(rows, F.col("v"), "value").where(F.col("n") >= least)
    return counts if k is None else counts.orderBy(F.desc("n"), F.asc("value")).limit(k)
