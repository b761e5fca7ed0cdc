"""Percentiles per group from dyadic count-sketches.

Values are encoded in 64 bits so that codes sort as the values do. For each of the
lower 52 binary resolutions of the codes a group's sketch holds one signed
count-sketch of ``DEPTH`` rows by ``WIDTH`` counters; the resolution above, of 4096
cells, is counted exactly. Sketches are linear: they are merged by adding counters, and
rows are taken out again by adding them with negative weight. A rank is inverted by
descending the resolutions, going left or right by the estimated count of the left
half. A group of few distinct values keeps them with their counts, and its
percentiles are exact.

See Wang, Luo, Yi and Cormode, "Quantiles over data streams" (2013).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.keyed import NAMES, flat, merge_states, mix, partial_states
from tessella.session import partitions_of

SIGN = np.uint64(1 << 63)


def encode_double(values: np.ndarray) -> np.ndarray:
    """Codes that sort as the numbers do; 0.0 and -0.0 are one."""
    bits = (values + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def decode_double(codes: np.ndarray) -> np.ndarray:
    return (codes ^ ((codes >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)


class Dyadic:
    """The sketch's parameters and its operations on one flat array of counters."""

    counted = True
    LEVELS = 52

    def __init__(self, width: int = 2048, depth: int = 5, capacity: int = 2048, carried: int = 1 << 16, seed: int = 20130407):
        bits = width.bit_length() - 1
        if width != 1 << bits or depth * (bits + 1) > 64 or depth % 2 == 0:
            raise ValueError("width must be a power of two and depth odd, with depth * (log2(width) + 1) at most 64")
        self.width, self.depth, self.bits, self.capacity, self.carried = width, depth, bits, capacity, carried
        self.seeds = np.random.default_rng(seed).integers(0, 2**64, self.LEVELS, dtype=np.uint64)
        self.top = self.LEVELS * depth * width
        self.size = self.top + (1 << (64 - self.LEVELS))

    @property
    def rank_error(self) -> float:
        """The error of a rank as a share of all values, kept with probability 0.99 or more.

        A level errs by about n / width (what is left after its heaviest ``width`` nodes
        cannot weigh more), a median of ``depth`` rows by less, and independent errors of
        all levels add up by the root of their number; twice that is the bound.
        """
        return 2 * sqrt(self.LEVELS) / self.width

    def empty(self) -> np.ndarray:
        return np.zeros(self.size, np.int64)

    def _cells(self, nodes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(nodes + self.seeds[level])
        rows = np.arange(self.depth, dtype=np.uint64)[:, None]
        part = h[None, :] >> (rows * np.uint64(self.bits + 1))
        cell = (part & np.uint64(self.width - 1)).astype(np.int64) + np.arange(self.depth)[:, None] * self.width
        return cell, 1 - 2 * ((part >> np.uint64(self.bits)) & np.uint64(1)).astype(np.int64)

    def add(self, sketch: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> None:
        nodes, weights = codes.view(np.uint64) ^ SIGN, counts
        span = self.depth * self.width
        for level in range(self.LEVELS):
            cell, sign = self._cells(nodes, level)
            added = np.bincount(cell.ravel(), weights=(sign * weights).ravel(), minlength=span)
            sketch[level * span : (level + 1) * span] += added.astype(np.int64)
            nodes = nodes >> np.uint64(1)
            new = np.ones(len(nodes), bool)
            new[1:] = nodes[1:] != nodes[:-1]
            at = np.flatnonzero(new)
            nodes, weights = nodes[at], np.add.reduceat(weights, at)
        np.add.at(sketch, self.top + nodes.astype(np.int64), weights)

    def merge(self, sketch: np.ndarray, other: np.ndarray) -> None:
        sketch += other

    def pack(self, sketch: np.ndarray) -> bytes:
        return pa.Codec("zstd", 1).compress(sketch.tobytes(), asbytes=True)

    def unpack(self, data: bytes) -> np.ndarray:
        return np.frombuffer(pa.Codec("zstd").decompress(data, self.size * 8), np.int64).copy()

    def estimate(self, sketch: np.ndarray, nodes: np.ndarray, level: int) -> np.ndarray:
        cell, sign = self._cells(nodes, level)
        return np.median(sketch[level * self.depth * self.width + cell] * sign, axis=0)

    def invert(self, sketch: np.ndarray, shares: Sequence[float]) -> tuple[int, np.ndarray]:
        """The number of values, and the code at each share of them."""
        exact = np.cumsum(sketch[self.top :])
        n = int(exact[-1])
        if n <= 0:
            return max(n, 0), np.zeros(0, np.int64)
        rank = np.array([max(1, ceil(p * n)) for p in shares], dtype=np.float64)
        node = np.searchsorted(exact, rank)
        inside = np.diff(exact, prepend=0)[node].astype(np.float64)
        rank -= exact[node] - inside
        node = node.astype(np.uint64)
        for level in range(self.LEVELS - 1, -1, -1):
            left = node << np.uint64(1)
            held = np.clip(self.estimate(sketch, left, level), 0, inside)
            right = rank > held
            node = left + right.astype(np.uint64)
            rank = np.where(right, rank - held, rank)
            inside = np.where(right, inside - held, held)
        return n, (node ^ SIGN).view(np.int64)


def percentile_states(df: DataFrame, by: Sequence[str], value: str, kind: Dyadic | None = None, weight: str | None = None) -> DataFrame:
    """A mergeable state per group of ``by`` for the distribution of ``value``.

    ``value`` may be any number; it is taken as a double. Null and NaN take no part;
    infinities are values. ``weight`` names a column of whole numbers by which a row
    counts, negative ones taking values out; null counts as 0. Null keys are keys like
    any other; groups without a value have no state; an empty table gives none.
    """
    kind = kind or Dyadic()
    number = F.col(f"`{value}`").cast("double")
    states = partial_states(df, by, F.when(~F.isnan(number), number), kind, None if weight is None else F.col(f"`{weight}`"), encode_double)
    return merge_states(states, by, kind, partitions_of(df))


def merged(states: DataFrame, by: Sequence[str], kind: Dyadic | None = None, parts: int | None = None) -> DataFrame:
    """The states of coarser groups, or of several days or segments together.

    ``parts`` is the number of partitions that may each hold states of a group; where it
    is not given, it is taken from the plan. See :func:`merge_states`.
    """
    return merge_states(states, by, kind or Dyadic(), partitions_of(states) if parts is None else parts)


def negated(states: DataFrame, kind: Dyadic | None = None) -> DataFrame:
    """States that take the values of ``states`` out of those they are merged with."""
    kind = kind or Dyadic()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [None if v is None else kind.pack(-kind.unpack(v)) for v in batch.column("sketch").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("sketch"), "sketch", pa.array(data, pa.binary()))

    return states.withColumn("counts", F.transform("counts", lambda c: -c)).mapInArrow(run, states.schema)


def percentiles(states: DataFrame, by: Sequence[str], shares: Sequence[float], kind: Dyadic | None = None) -> DataFrame:
    """(``by``, n, share, value, rank_error): for each group and share p the smallest value with at least p * n values up to it.

    ``rank_error`` is the most by which the value's rank may differ from the rank asked
    for: 0 where the state is exact, else a share of n stated in :class:`Dyadic`. States
    of which nothing is left give no rows. ``by`` must not hold an output's name.
    """
    if {"n", "share", "value", "rank_error"} & set(by):
        raise ValueError("group columns may not be named n, share, value or rank_error")
    kind = kind or Dyadic()
    schema = T.StructType(
        [
            *(states.schema[c] for c in by),
            T.StructField("n", T.LongType()),
            T.StructField("share", T.DoubleType()),
            T.StructField("value", T.DoubleType()),
            T.StructField("rank_error", T.LongType()),
        ]
    )
    shares = [float(p) for p in shares]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, codes, counts, packed = flat(batch, True)
            n = np.bincount(row, weights=counts, minlength=batch.num_rows).astype(np.int64)
            value = np.zeros((batch.num_rows, len(shares)))
            error = np.zeros(batch.num_rows, np.int64)
            rows = np.flatnonzero(n > 0)
            if len(rows):
                upto = np.cumsum(counts)
                before = (np.cumsum(n) - n)[rows]
                for j, p in enumerate(shares):
                    rank = np.maximum(1, np.ceil(p * n[rows])).astype(np.int64)
                    value[rows, j] = decode_double(codes[np.searchsorted(upto, before + rank)])
            for r, data in packed:
                n[r], code = kind.invert(kind.unpack(data), shares)
                if n[r]:
                    value[r], error[r] = decode_double(code), ceil(kind.rank_error * n[r])
            some = np.repeat(np.flatnonzero(n > 0), len(shares))
            keys = batch.select(list(by)).take(pa.array(some, pa.int64())) if by else None
            columns = [pa.array(n[some]), pa.array(np.tile(shares, len(some) // max(1, len(shares))), pa.float64()), pa.array(value[n > 0].ravel()), pa.array(error[some])]
            yield pa.RecordBatch.from_arrays([*(keys.columns if by else []), *columns], names=schema.names)

    return states.select(*(F.col(f"`{c}`") for c in by), *NAMES).mapInArrow(run, schema)
