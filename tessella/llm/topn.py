"""The N best rows of every group, by a secondary sort and a stream over its result.

Rows are sorted within each input partition by group, score and identifier, and a
stream over the Arrow batches passes on the first N of each group. What is left, at
most N rows per group and partition, is partitioned by group and put through the same
sort and stream. A group with a third of all rows therefore sends N rows per input
partition through the shuffle, and no group is ever held in memory: between batches
the stream keeps the key, the count and the at most N identifiers of the open group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.runs import key_of, run_starts


def _first_n(by: Sequence[str], ident: str, n: int, rank: str | None):
    """A stream over sorted batches that passes on the first ``n`` distinct identifiers of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key: tuple | None = None
        taken, taken_ids = 0, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            starts = run_starts(batch, by)
            continued = open_key is not None and key_of(batch, 0, by) == open_key
            if continued and taken >= n:
                # the open group is full, however many of its rows follow
                rest = int(np.flatnonzero(starts)[1]) if starts.sum() > 1 else batch.num_rows
                batch, starts, continued = batch.slice(rest), starts[rest:], False
                if batch.num_rows == 0:
                    continue
            group = np.cumsum(starts) - 1
            ids = batch.column(ident)
            known = ~ids.is_null().to_numpy(zero_copy_only=False)
            number = ids.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            again = pd.DataFrame({"g": group, "i": number}).duplicated().to_numpy() & known
            if continued and len(taken_ids):
                here = int(np.searchsorted(group, 1))
                again[:here] |= pc.is_in(ids.slice(0, here), value_set=taken_ids, skip_nulls=True).to_numpy(zero_copy_only=False)
            fresh = ~again
            count = np.cumsum(fresh)
            first = np.flatnonzero(starts)
            before = count[first] - fresh[first]
            place = count - before[group]
            if continued:
                place[group == 0] += taken
            keep = fresh & (place <= n)
            last = int(first[-1])
            if not (continued and last == 0):
                open_key, taken, taken_ids = key_of(batch, last, by), 0, ids.slice(0, 0)
            mine = ids.take(pa.array(np.flatnonzero(keep[last:]) + last)).drop_null()
            taken += int(fresh[last:].sum())
            taken_ids = pa.concat_arrays([taken_ids, mine])  # at most n
            out = batch.filter(pa.array(keep))
            if rank is not None:
                out = out.append_column(rank, pa.array(place[keep].astype(np.int32)))
            if out.num_rows:
                yield out

    return run


def top_n_per_group(df: DataFrame, by: Sequence[str], score: str, ident: str, n: int, rank: str = "rank_in_group") -> DataFrame:
    """(``by``, ``ident``, ``score``, ``rank``): for every group the ``n`` rows with the highest ``score``.

    Ties go to the smaller ``ident``, so the result never depends on partitioning. An
    ``ident`` that occurs repeatedly in a group counts once, with its highest score.
    Rows with a null score take no part; a null in ``by`` is a group key like any
    other; a null ``ident`` comes after all others at equal score and is never taken
    for a repetition. NaN scores rank highest, as Spark orders them. Other columns are
    not read. An empty table gives no rows.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    keys = [f"__k{i}" for i in range(len(by))]
    rows = df.select(
        *(F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)), F.col(f"`{ident}`").alias("__id"), F.col(f"`{score}`").alias("__score")
    ).where(F.col("__score").isNotNull())
    order = [*(F.asc(k) for k in keys), F.desc("__score"), F.asc_nulls_last("__id")]
    best = rows.sortWithinPartitions(*order).mapInArrow(_first_n(keys, "__id", n, None), rows.schema)
    ranked = T.StructType([*rows.schema.fields, T.StructField(rank, T.IntegerType())])
    return (
        best.repartition(*keys)
        .sortWithinPartitions(*order)
        .mapInArrow(_first_n(keys, "__id", n, rank), ranked)
        .withColumnsRenamed({**dict(zip(keys, by)), "__id": ident, "__score": score})
    )
