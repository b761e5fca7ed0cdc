"""Runs of equal keys in sorted Arrow batches, found without a Python loop over rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _differs(column: pa.Array) -> np.ndarray:
    """For rows 1.. of a column: is the value another one than in the row before (null equals null)?"""
    now, before = column.slice(1), column.slice(0, len(column) - 1)
    unequal = pc.not_equal(now, before)
    if pa.types.is_floating(column.type):
        unequal = pc.and_(unequal, pc.invert(pc.and_(pc.is_nan(now), pc.is_nan(before))))
    one_null = pc.xor(pc.is_null(now), pc.is_null(before))
    return pc.or_(pc.fill_null(unequal, False), one_null).to_numpy(zero_copy_only=False)


def run_starts(batch: pa.RecordBatch, by: Sequence[str]) -> np.ndarray:
    """True at each row that begins a run of equal ``by`` values; row 0 always begins one."""
    starts = np.zeros(batch.num_rows, dtype=bool)
    if batch.num_rows:
        starts[0] = True
        for name in by:
            starts[1:] |= _differs(batch.column(name))
    return starts


def key_of(batch: pa.RecordBatch, row: int, by: Sequence[str]) -> tuple:
    """The ``by`` values of one row, comparable with ``==`` (NaN equals NaN)."""
    values = (batch.column(name)[row].as_py() for name in by)
    return tuple("nan" if isinstance(v, float) and v != v else (v,) for v in values)


def by_bytes(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Slices of a batch that hold about ``most`` bytes of a string column each, or one longer row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(first, last - first)
        first = last
