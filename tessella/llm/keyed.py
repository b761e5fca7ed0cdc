"""States per group that start as exact lists and turn into sketches of fixed size.

A state is a row: the group's keys, a sorted list of 64-bit codes with their counts
while there are few, or the packed bytes of a sketch. States are built within each
input partition from rows sorted by group, so a group of any size is folded where its
rows lie; only states are shuffled, and those of a group are merged in a stream. In
both streams one group is open at a time, with at most a capacity of codes and one
sketch in memory; groups that lie within one batch are folded together by array
operations.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.runs import key_of, run_starts

PAYLOAD = [
    T.StructField("codes", T.ArrayType(T.LongType(), False)),
    T.StructField("counts", T.ArrayType(T.LongType(), False)),
    T.StructField("sketch", T.BinaryType()),
]
NAMES = [f.name for f in PAYLOAD]
#: States of one group that are merged in one task, about.
FAN = 256


def mix(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers with their bits mixed, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Kind(Protocol):
    """What a kind of sketch has to do; ``counted`` says whether counts matter."""

    counted: bool
    capacity: int  # codes kept in a list in a merged state
    carried: int  # codes kept in a list in a state on its way to the merge

    def empty(self) -> np.ndarray: ...
    def add(self, sketch: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> None: ...
    def merge(self, sketch: np.ndarray, other: np.ndarray) -> None: ...
    def pack(self, sketch: np.ndarray) -> bytes: ...
    def unpack(self, data: bytes) -> np.ndarray: ...


class _Open:
    """The state of one group while it grows."""

    def __init__(self, kind: Kind, capacity: int):
        self.kind, self.capacity = kind, capacity
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0
        self.sketch: np.ndarray | None = None

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.codes.append(codes)
        self.counts.append(counts)
        self.held += len(codes)
        if self.held > 2 * self.capacity or (self.sketch is not None and self.held > 1 << 16):
            self._settle()

    def merge(self, data: bytes) -> None:
        other = self.kind.unpack(data)
        if self.sketch is None:
            self.sketch = other
        else:
            self.kind.merge(self.sketch, other)

    def _settle(self) -> None:
        codes, counts = combine(np.concatenate(self.codes), np.concatenate(self.counts), self.kind.counted) if self.codes else (np.zeros(0, np.int64),) * 2
        self.codes, self.counts, self.held = [codes], [counts], len(codes)
        if len(codes) > self.capacity or (self.sketch is not None and len(codes)):
            if self.sketch is None:
                self.sketch = self.kind.empty()
            self.kind.add(self.sketch, codes, counts)
            self.codes, self.counts, self.held = [], [], 0

    def close(self) -> tuple[np.ndarray, np.ndarray, bytes | None]:
        self._settle()
        if self.sketch is not None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), self.kind.pack(self.sketch)
        return self.codes[0], self.counts[0], None


def combine(codes: np.ndarray, counts: np.ndarray, counted: bool, group: np.ndarray | None = None):
    """Each code once, in order, with its counts added up and those that cancel left out; by group where given."""
    if group is None:
        order = np.argsort(codes, kind="stable")
    else:
        order = np.lexsort((codes, group))
        group = group[order]
    codes, counts = codes[order], counts[order]
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    if group is not None:
        new[1:] |= group[1:] != group[:-1]
    at = np.flatnonzero(new)
    total = np.add.reduceat(counts, at) if len(at) else counts
    keep = total != 0 if counted else np.ones(len(at), bool)
    return (codes[at][keep], total[keep]) if group is None else (codes[at][keep], total[keep], group[at][keep])


class Folder:
    """Folds rows sorted by group into one state per group."""

    def __init__(self, by: Sequence[str], kind: Kind, capacity: int):
        self.by, self.kind, self.capacity = list(by), kind, capacity
        self.key: tuple | None = None
        self.key_row: pa.RecordBatch | None = None
        self.open: _Open | None = None

    def feed(self, keys: pa.RecordBatch, row: np.ndarray, codes: np.ndarray, counts: np.ndarray, packed: Sequence[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        """Take rows' codes (``row`` says whose) and sketches; give the states of groups that are over."""
        if keys.num_rows == 0:
            return
        starts = run_starts(keys, self.by)
        first = np.flatnonzero(starts)
        of_row = np.cumsum(starts) - 1
        codes, counts, group = combine(codes, counts, self.kind.counted, of_row[row])
        sizes = np.bincount(group, minlength=len(first))
        ends = np.cumsum(sizes)
        sketches: dict[int, list[bytes]] = {}
        for r, data in packed:
            sketches.setdefault(int(of_row[r]), []).append(data)
        last = len(first) - 1
        continued = self.open is not None and key_of(keys, 0, self.by) == self.key
        if self.open is not None and not continued:
            yield self._closed()
        single = np.zeros(len(first), bool)
        single[[0, last, *sketches]] = True
        single |= sizes > self.capacity
        bulk = np.flatnonzero(~single)
        if len(bulk):
            chosen = np.repeat(~single, sizes)
            yield self._batch(keys.take(pa.array(first[bulk])), sizes[bulk], codes[chosen], counts[chosen], [None] * len(bulk))
        for g in np.flatnonzero(single).tolist():
            if not (g == 0 and continued):
                if self.open is not None:
                    yield self._closed()
                self.open = _Open(self.kind, self.capacity)
                self.key, self.key_row = key_of(keys, int(first[g]), self.by), keys.slice(int(first[g]), 1)
            for data in sketches.get(g, ()):
                self.open.merge(data)
            a, b = ends[g] - sizes[g], ends[g]
            if b > a:
                self.open.add(codes[a:b], counts[a:b])

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.open is not None:
            yield self._closed()

    def _closed(self) -> pa.RecordBatch:
        codes, counts, data = self.open.close()
        self.open = None
        return self._batch(self.key_row, np.array([len(codes)]), codes, counts, [data])

    def _batch(self, keys: pa.RecordBatch, sizes: np.ndarray, codes: np.ndarray, counts: np.ndarray, data: list) -> pa.RecordBatch:
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        item = pa.field("element", pa.int64(), nullable=False)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int64()), type=pa.list_(item)) for v in (codes, counts if self.kind.counted else codes[:0])[:1]]
        if self.kind.counted:
            lists.append(pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()), type=pa.list_(item)))
        else:
            lists.append(pa.ListArray.from_arrays(pa.array(np.zeros(len(sizes) + 1, np.int32)), pa.array([], pa.int64()), type=pa.list_(item)))
        return pa.RecordBatch.from_arrays([*(keys.column(k) for k in self.by), *lists, pa.array(data, pa.binary())], names=[*self.by, *NAMES])


def _keyed(df: DataFrame, by: Sequence[str], *more) -> tuple[DataFrame, list[str]]:
    """``df`` with internal names for its keys, one that is always the same where there are none."""
    keys = [f"__k{i}" for i in range(len(by))] or ["__all"]
    columns = [F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)] or [F.lit(0).alias("__all")]
    return df.select(*columns, *more), keys


def _named(states: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return states.withColumnsRenamed(dict(zip(keys, by))) if by else states.drop("__all")


def _checked(by: Sequence[str]) -> None:
    if set(by) & set(NAMES):
        raise ValueError(f"group columns may not be named {', '.join(NAMES)}")


def partial_states(df: DataFrame, by: Sequence[str], code, kind: Kind, weight=None, encode=None) -> DataFrame:
    """A state for each group in each input partition, without a shuffle.

    ``code`` is a Column of numbers that ``encode`` turns into 64-bit codes; rows where it
    is null take no part. ``weight`` is a Column of whole numbers, 1 if not given.
    """
    _checked(by)
    rows, keys = _keyed(df, by, code.alias("__code"), *([] if weight is None else [weight.cast("long").alias("__n")]))
    rows = rows.where(F.col("__code").isNotNull())
    schema = T.StructType([*rows.schema.fields[: len(keys)], *PAYLOAD])
    weighted = weight is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(keys, kind, kind.carried)
        for batch in batches:
            codes = batch.column("__code").to_numpy(zero_copy_only=False)
            codes = codes if encode is None else encode(codes)
            counts = np.ones(len(codes), np.int64) if not weighted else batch.column("__n").fill_null(0).to_numpy(zero_copy_only=False)
            yield from folder.feed(batch.select(keys), np.arange(len(codes)), codes, counts, [])
        yield from folder.end()

    return _named(rows.sortWithinPartitions(*keys).mapInArrow(run, schema), by, keys)


def flat(batch: pa.RecordBatch, counted: bool):
    """The codes of a batch of states with their row and counts, and its sketches with their row."""
    lists = batch.column("codes")
    codes = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    counts = batch.column("counts").flatten().to_numpy(zero_copy_only=False) if counted else np.ones(len(codes), np.int64)
    data = batch.column("sketch")
    packed = [(int(r), data[int(r)].as_py()) for r in np.flatnonzero(data.is_valid().to_numpy(zero_copy_only=False))]
    return row, codes, counts, packed


def _merge_once(rows: DataFrame, keys: Sequence[str], kind: Kind, capacity: int, parts: int) -> DataFrame:
    """One state for each combination of ``keys``, the first columns of ``rows``."""
    schema = T.StructType([*(rows.schema[k] for k in keys), *PAYLOAD])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(keys, kind, capacity)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield from folder.feed(part.select(keys), *flat(part, kind.counted))
        yield from folder.end()

    # a number that is given is kept: few bytes of states are still much work, which must not be put into one task
    spark = rows.sparkSession
    count = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(2 * spark.sparkContext.defaultParallelism, parts))
    return rows.repartition(count, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def merge_states(states: DataFrame, by: Sequence[str], kind: Kind, parts: int = 1) -> DataFrame:
    """One state per group of ``by``, from any number of states of finer groups, segments or days.

    ``parts`` is the number of partitions that may each hold a state of the same group. Where
    it is above ``FAN``, states are first merged by group and share of the partitions, so
    that no task meets more than about ``FAN`` states of a group, however many partitions
    it lies in. A group whose codes all cancel out is left with an empty list. An empty
    table gives no states; null keys are keys like any other.
    """
    _checked(by)
    rows, keys = _keyed(states, by, *NAMES)
    shares = -(-parts // FAN)
    if shares > 1:
        rows = rows.withColumn("__share", F.spark_partition_id())
    while shares > 1:
        rows = rows.withColumn("__share", F.pmod("__share", F.lit(shares)))
        rows = _merge_once(rows.select(*keys, "__share", *NAMES), [*keys, "__share"], kind, kind.carried, parts)
        shares = -(-shares // FAN) if shares > FAN else 1
    return _named(_merge_once(rows.select(*keys, *NAMES), keys, kind, kind.capacity, parts), by, keys)
