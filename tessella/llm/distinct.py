"""Distinct counts per group, and of what two groups share, from set sketches.

A sketch has ``m`` registers. Each holds the largest ``floor(1 - log_b(x))`` over the
exponentially distributed numbers x that the set's elements draw for it, so registers
are merged by their maximum, and the base ``b`` sets how finely they tell sets apart. A
small set keeps its elements' 64-bit hashes and is exact. Union, intersection and
Jaccard similarity of two sets follow from one likelihood of their registers being
larger, smaller or equal, given both counts.

See Ertl, "SetSketch: filling the gap between MinHash and HyperLogLog" (2021).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import exp, log, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.keyed import NAMES, flat, merge_states, mix, partial_states
from tessella.session import partitions_of

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class Registers:
    """The sketch's parameters and its operations on an array of ``m`` registers."""

    counted = False
    #: Numbers drawn at once.
    DRAWS = 1 << 18

    def __init__(self, m: int = 4096, b: float = 1.001, a: float = 20.0, capacity: int = 1024, carried: int = 4096):
        if m != 1 << (m.bit_length() - 1) or m < 16 or not 1 < b <= 2:
            raise ValueError("m must be a power of two from 16 on, and b above 1 and at most 2")
        self.m, self.b, self.a, self.capacity, self.carried = m, b, a, capacity, carried
        self.most = 65535
        self.ln_b = log(b)

    @property
    def relative_error(self) -> float:
        """Standard deviation of a count, as a share of it."""
        return sqrt(((self.b + 1) / (self.b - 1) * self.ln_b - 1) / self.m)

    def empty(self) -> np.ndarray:
        return np.zeros(self.m, np.int32)

    def _place(self, step: np.ndarray, key: np.ndarray) -> np.ndarray:
        """A permutation of the registers for each key, at the given steps."""
        mask = np.uint64(self.m - 1)
        half = np.uint64((self.m.bit_length() - 1) // 2 + 1)
        x = (step + key) & mask
        x = (x * ((key >> np.uint64(16)) | np.uint64(1))) & mask
        x ^= x >> half
        x = (x * ((key >> np.uint64(32)) | np.uint64(1)) + (key >> np.uint64(48))) & mask
        x ^= x >> half
        return x

    def add(self, sketch: np.ndarray, codes: np.ndarray, counts: np.ndarray | None = None) -> None:
        """Let each element draw its numbers in ascending order, up to the last that can raise a register."""
        hashes = mix(codes.view(np.uint64))
        at, size = 0, 16
        while at < len(hashes):
            h = hashes[at : at + size]
            at += size
            size = min(at, 1 << 15)
            key = mix(h ^ GOLDEN)
            sofar = np.zeros(len(h))
            step = 0
            while len(h) and step < self.m:
                enough = exp(-self.ln_b * int(sketch.min()))  # a number above this raises no register
                expected = self.m * (1 - exp(-self.a * enough))  # numbers below it that an element draws, on average
                n = int(min(self.m - step, max(1, self.DRAWS // len(h)), 4 + (expected if step == 0 else expected / 2)))
                steps = np.arange(step, step + n, dtype=np.uint64)
                uniform = ((mix(h[:, None] + (steps + np.uint64(1)) * GOLDEN) >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53
                drawn = sofar[:, None] + np.cumsum(-np.log(uniform) / (self.a * (self.m - steps.astype(np.float64))), axis=1)
                of, which = np.nonzero(drawn <= enough)
                if len(of):
                    value = np.clip(np.floor(1 - np.log(drawn[of, which]) / self.ln_b), 0, self.most).astype(np.int32)
                    np.maximum.at(sketch, self._place(steps[which], key[of]).astype(np.int64), value)
                going = drawn[:, -1] <= enough
                h, key, sofar = h[going], key[going], drawn[going, -1]
                step += n

    def merge(self, sketch: np.ndarray, other: np.ndarray) -> None:
        np.maximum(sketch, other, out=sketch)

    def pack(self, sketch: np.ndarray) -> bytes:
        return sketch.astype(np.uint16).tobytes()

    def unpack(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, np.uint16).astype(np.int32)

    def count(self, sketch: np.ndarray) -> float:
        if not sketch.any():
            return 0.0
        return self.m * (1 - 1 / self.b) / (self.a * self.ln_b * float(np.exp(-self.ln_b * sketch.astype(np.float64)).sum()))

    def _jaccard(self, larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The most likely Jaccard similarities, and their standard errors, of pairs of sets that hold shares u and v of both counts."""
        top = np.minimum(u / v, v / u)

        def p(x: np.ndarray) -> np.ndarray:
            return -np.log(np.maximum(1e-300, 1 - np.maximum(x, 0.0) * (self.b - 1) / self.b)) / self.ln_b

        def probability(j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            up, down = p(u - v * j), p(v - u * j)
            return up, down, 1 - up - down

        def likelihood(j: np.ndarray) -> np.ndarray:
            return sum(np.where(d > 0, d * np.log(np.maximum(q, 1e-300)), 0.0) for d, q in zip((larger, smaller, equal), probability(j)))

        lo, hi, ratio = np.zeros(len(top)), top.copy(), (sqrt(5) - 1) / 2
        for _ in range(60):  # the likelihood has one peak
            one, two = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
            rising = likelihood(one) < likelihood(two)
            lo, hi = np.where(rising, one, lo), np.where(rising, hi, two)
        choices = np.stack([(lo + hi) / 2, np.zeros(len(top)), top])
        j = choices[np.stack([likelihood(c) for c in choices]).argmax(axis=0), np.arange(len(top))]
        near = np.where(top > 2e-4, np.minimum(np.maximum(j, 1e-4), top - 1e-6), j)
        step = 1e-5
        slopes = [(a - b) / (2 * step) for a, b in zip(probability(near + step), probability(near - step))]
        information = self.m * sum(s * s / np.maximum(q, 1e-12) for s, q in zip(slopes, probability(near)))
        # the likelihood takes both counts as known; their own errors, alike as far as the sets are, come on top
        counts = 2 * j * j * (1 - j) / self.m
        return j, np.sqrt(np.where(information > 0, 1 / np.where(information > 0, information, 1.0), 1.0) + counts)

    def counts(self, sketches: np.ndarray) -> np.ndarray:
        """The count of each row of registers."""
        total = np.exp(-self.ln_b * sketches.astype(np.float64)).sum(axis=1)
        return np.where(sketches.any(axis=1), self.m * (1 - 1 / self.b) / (self.a * self.ln_b * total), 0.0)

    def joints(self, left: np.ndarray, right: np.ndarray) -> dict[str, np.ndarray]:
        """Estimates for pairs of sketched sets, a row of registers each."""
        n, k = self.counts(left), self.counts(right)
        j, error = np.zeros(len(n)), np.zeros(len(n))
        some = np.flatnonzero((n > 0) & (k > 0))
        if len(some):
            x, y, total = left[some], right[some], (n + k)[some]
            j[some], error[some] = self._jaccard((x > y).sum(axis=1), (x < y).sum(axis=1), (x == y).sum(axis=1), n[some] / total, k[some] / total)
        return {"n_union": (n + k) / (1 + j), "n_both": (n + k) * j / (1 + j), "jaccard": j, "jaccard_error": error}

    def joint(self, left: np.ndarray, right: np.ndarray) -> dict[str, float]:
        """Estimates for two sketched sets."""
        return {name: float(v[0]) for name, v in self.joints(left[None, :], right[None, :]).items()}


def distinct_states(df: DataFrame, by: Sequence[str], value: str, kind: Registers | None = None, merge: bool = True) -> DataFrame:
    """A mergeable state per group of ``by`` for the set of ``value``s, of any type that can be hashed.

    Values are told apart by 64-bit hashes. Nulls take no part; NaN is a value; null keys
    are keys like any other; groups without a value have no state; an empty table gives
    none. With ``merge`` off, there is a state per group and input partition, for
    merging by other groups at once.
    """
    kind = kind or Registers()
    column = F.col(f"`{value}`")
    states = partial_states(df, by, F.when(column.isNotNull(), F.xxhash64(column)), kind)
    return merge_states(states, by, kind, partitions_of(df)) if merge else states


def merged(states: DataFrame, by: Sequence[str], kind: Registers | None = None, parts: int | None = None) -> DataFrame:
    """The states of coarser groups, or of several days or segments together; see :func:`merge_states` for ``parts``."""
    return merge_states(states, by, kind or Registers(), partitions_of(states) if parts is None else parts)


def distinct_counts(states: DataFrame, by: Sequence[str], kind: Registers | None = None) -> DataFrame:
    """(``by``, n_distinct, standard_error): the number of distinct values of each state; the error is 0 where it is exact."""
    kind = kind or Registers()
    if {"n_distinct", "standard_error"} & set(by):
        raise ValueError("group columns may not be named n_distinct or standard_error")
    schema = T.StructType([*(states.schema[c] for c in by), T.StructField("n_distinct", T.LongType()), T.StructField("standard_error", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, codes, _, packed = flat(batch, False)
            n = np.bincount(row, minlength=batch.num_rows).astype(np.int64)
            error = np.zeros(batch.num_rows)
            for r, data in packed:
                estimate = kind.count(kind.unpack(data))
                n[r], error[r] = round(estimate), estimate * kind.relative_error
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], pa.array(n), pa.array(error)], names=schema.names)

    return states.select(*(F.col(f"`{c}`") for c in by), *NAMES).mapInArrow(run, schema)


#: Pairs of states unpacked at once.
ROWS = 256
OVERLAP = ["n_left", "n_right", "n_union", "n_both", "jaccard", "jaccard_error"]


def overlaps(pairs: DataFrame, keep: Sequence[str], kind: Registers | None = None) -> DataFrame:
    """(``keep``, n_left, n_right, n_union, n_both, jaccard, jaccard_error) for rows that hold two states.

    ``pairs`` has the structs ``left`` and ``right`` of the columns of a state; a null one is
    the empty set. Two exact states give exact figures and an error of 0. The error is
    the standard error of the Jaccard similarity from the likelihood's information.
    """
    kind = kind or Registers()
    if set(OVERLAP) & set(keep):
        raise ValueError("kept columns may not bear the name of an output")
    schema = T.StructType([*(pairs.schema[c] for c in keep), *(T.StructField(c, T.DoubleType()) for c in OVERLAP)])

    def parts(states: pa.StructArray) -> tuple:
        row, codes, _, packed = flat(pa.RecordBatch.from_arrays([pc.struct_field(states, name) for name in NAMES], names=NAMES), False)
        return row, codes, dict(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                sides = [parts(batch.column(side)) for side in ("left", "right")]
                sizes = [np.bincount(row, minlength=batch.num_rows) for row, _, _ in sides]
                # exact states: codes of both sides next to each other, row by row
                row, codes = (np.concatenate([s[i] for s in sides]) for i in (0, 1))
                order = np.lexsort((codes, row))
                row, codes = row[order], codes[order]
                same = np.bincount(row[1:][(row[1:] == row[:-1]) & (codes[1:] == codes[:-1])], minlength=batch.num_rows)
                union = sizes[0] + sizes[1] - same
                out = [*(s.astype(np.float64) for s in sizes), union.astype(np.float64), same.astype(np.float64), np.divide(same, union, out=np.zeros(len(union)), where=union > 0), np.zeros(len(union))]
                some = sorted(sides[0][2].keys() | sides[1][2].keys())
                if some:
                    sketches = np.zeros((2, len(some), kind.m), np.int32)
                    for side, (of, codes, packed) in enumerate(sides):
                        for i, r in enumerate(some):
                            if r in packed:
                                sketches[side, i] = kind.unpack(packed[r])
                            else:
                                kind.add(sketches[side, i], codes[np.searchsorted(of, r) : np.searchsorted(of, r, side="right")])
                        held = np.array([r in packed for r in some])
                        out[side][some] = np.where(held, kind.counts(sketches[side]), sizes[side][some])
                    for column, values in zip(out[2:], kind.joints(*sketches).values()):
                        column[some] = values
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c, pa.float64()) for c in out)], names=schema.names)

    return pairs.select(*(F.col(f"`{c}`") for c in keep), "left", "right").mapInArrow(run, schema)
