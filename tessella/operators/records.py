"""Loading delimited records, with those that fail set apart and explained.

A batch of records is laid out as one text. A block of records is tried by one match of
its part of the text against the grammar of good records; a block that fails is cut in
two and each half tried again, down to single records. All records that pass are then
parsed together by one columnar CSV parse and typed by column kernels; only records
that were isolated go to a strict reader, which names the reason.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.runs import by_bytes
from tessella.session import spread

BLANKS = " \t"
#: Stand-ins for line breaks within a record while blocks are joined by line breaks.
BREAKS = {"\n": "\x01", "\r": "\x02"}
#: Records in the largest block tried at once, and bytes of records laid out as one text.
BLOCK, BATCH_BYTES = 4096, 4 << 20

NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
INT64_MAX = 2**63 - 1


@dataclass(frozen=True)
class Field:
    """A field of a record: its kind, and whether a bad value rejects the record or becomes null."""

    name: str
    kind: str  # key: 1..2^63-1 in digits; number: double or a word for none; integer; timestamp
    judged: bool = False


MENU_ITEM = (
    Field("id", "key", judged=True),
    Field("menu_page_id", "integer"),
    Field("price", "number", judged=True),
    Field("high_price", "number"),
    Field("dish_id", "integer"),
    Field("created_at", "timestamp"),
    Field("updated_at", "timestamp"),
    Field("xpos", "number"),
    Field("ypos", "number"),
)

_SPARK = {"key": T.LongType(), "integer": T.LongType(), "number": T.DoubleType(), "timestamp": T.TimestampNTZType()}
_ARROW = {"key": pa.int64(), "integer": pa.int64(), "number": pa.float64(), "timestamp": pa.timestamp("us")}


def _null_where(values: pa.Array, keep: pa.Array) -> pa.Array:
    return pc.if_else(keep, values, pa.scalar(None, values.type))


def _typed_key(text: pa.Array) -> tuple[pa.Array, pa.Array]:
    digits = pc.match_substring_regex(text, r"\A0*[0-9]{1,19}\z")
    stripped = pc.ascii_ltrim(text, "0")
    size = pc.utf8_length(stripped)
    top = pa.scalar(str(INT64_MAX))
    fits = pc.or_(pc.less(size, 19), pc.and_(pc.equal(size, 19), pc.less_equal(stripped, top)))
    ok = pc.and_(digits, pc.and_(fits, pc.greater(size, 0)))
    return pc.cast(_null_where(stripped, ok), pa.int64()), ok


def _typed_integer(text: pa.Array) -> tuple[pa.Array, pa.Array]:
    ok = pc.match_substring_regex(text, r"\A[+-]?[0-9]{1,18}\z")
    return pc.cast(_null_where(pc.ascii_ltrim(text, "+"), ok), pa.int64()), ok


def _typed_number(text: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Empty and ``None`` are null and ``nan`` is NaN; all three are valid."""
    number = pc.match_substring_regex(text, rf"\A{NUMBER}\z")
    void = pc.is_in(text, pa.array(["", "None"]))
    nan = pc.equal(text, "nan")
    plain = _null_where(pc.ascii_ltrim(text, "+"), number)
    try:
        values = pc.cast(plain, pa.float64())
    except pa.ArrowInvalid:  # out of range of the columnar reader: infinity or zero
        values = pa.array([None if x is None else float(x) for x in plain.to_pylist()], pa.float64())
    values = pc.if_else(nan, pa.scalar(float("nan")), values)
    return values, pc.or_(number, pc.or_(void, nan))


def _typed_timestamp(text: pa.Array) -> tuple[pa.Array, pa.Array]:
    shaped = pc.match_substring_regex(text, r"\A[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}(?: UTC)?\z")
    cut = pc.utf8_slice_codeunits(_null_where(text, shaped), 0, 19)
    values = pc.strptime(cut, format="%Y-%m-%d %H:%M:%S", unit="s", error_is_null=True)
    same = pc.fill_null(pc.equal(pc.strftime(values, format="%Y-%m-%d %H:%M:%S"), cut), False)  # else February 30 were March 2
    return _null_where(values, same).cast(pa.timestamp("us")), same


def _judge_key(cell: str) -> bool:
    return bool(re.fullmatch(r"[0-9]+", cell)) and 1 <= int(cell.lstrip("0")[:20] or 0) <= INT64_MAX


def _judge_number(cell: str, number=re.compile(NUMBER)) -> bool:
    return cell in ("", "None", "nan") or number.fullmatch(cell) is not None


_JUDGE = {"key": _judge_key, "number": _judge_number}
_TYPED = {"key": _typed_key, "integer": _typed_integer, "number": _typed_number, "timestamp": _typed_timestamp}


def split_strict(raw: str) -> list[str] | None:
    """The fields of one record, or None where its quoting is broken.

    A quoted field begins with ``"`` and holds ``""`` for a quote; only a comma or the
    record's end may follow its closing quote. An unquoted field may hold no quote.
    """
    fields, at, end = [], 0, len(raw)
    while True:
        if raw[at : at + 1] == '"':
            parts, at = [], at + 1
            while True:
                quote = raw.find('"', at)
                if quote < 0:
                    return None
                parts.append(raw[at:quote])
                at = quote + 1
                if raw[at : at + 1] != '"':
                    break
                parts.append('"')
                at += 1
            if at < end and raw[at] != ",":
                return None
            fields.append("".join(parts))
        else:
            comma = raw.find(",", at)
            stop = end if comma < 0 else comma
            cell = raw[at:stop]
            if '"' in cell:
                return None
            fields.append(cell)
            at = stop
        if at >= end:
            return fields
        at += 1


class _Loader:
    """Splits batches of records into typed rows and reasons, by halves."""

    def __init__(self, spec: Sequence[Field]):
        self.spec = spec
        blank = f"[{BLANKS}]*+"
        any_cell = r'(?:(?:"[^"\n]*+")++|[^",\n]*+)'
        cells = {
            "key": lambda: rf"0*+[1-9][0-9]{{0,18}}{blank}",
            "number": lambda: rf"(?:None|nan|{NUMBER})?{blank}",
        }
        judged = {kind: rf'(?:"{blank}{cell()}"|{blank}{cell()})(?=[,\n])' for kind, cell in cells.items()}
        record = ",".join(judged[f.kind] if f.judged else any_cell for f in spec)
        self.grammar = re.compile(rf"(?:{record}\n)*+")
        self.names = [f"f{i}" for i in range(len(spec))]
        self.parse = csv.ParseOptions(delimiter=",", quote_char='"', double_quote=True, escape_char=False, newlines_in_values=False, ignore_empty_lines=False)
        self.convert = csv.ConvertOptions(column_types={n: pa.string() for n in self.names}, strings_can_be_null=False)
        self.judged = [(i, _JUDGE[f.kind], f.name) for i, f in enumerate(spec) if f.judged]
        self.seen = self.bad = 0
        #: Records read strictly, and blocks tried, so far.
        self.strictly = self.tried = 0

    def isolated(self, text: str, ends: list[int]) -> list[int]:
        """The records that fail by themselves, found by halving blocks that fail.

        Record i lies between ``ends[i]`` and ``ends[i + 1]``. A block is begun at the size in
        which, at the rate of failures so far, one is to be expected.
        """
        failed: list[int] = []
        at, last = 0, len(ends) - 1
        while at < last:
            size = min(BLOCK, max(1, self.seen // (self.bad + 1))) if self.seen else BLOCK
            before = len(failed)
            blocks = [(at, min(at + size, last))]
            at = blocks[0][1]
            self.seen += at - blocks[0][0]
            while blocks:
                lo, hi = blocks.pop()
                self.tried += 1
                if self.grammar.fullmatch(text, ends[lo], ends[hi]) is not None:
                    continue
                if hi - lo == 1:
                    failed.append(lo)
                else:
                    half = (lo + hi) // 2
                    blocks += ((half, hi), (lo, half))
            self.bad += len(failed) - before
        return failed

    def columns(self, records: list[str]) -> list[pa.Array] | None:
        """The fields of records that fit the grammar, as trimmed columns (None if the parser does not agree)."""
        data = ("\n".join(records) + "\n").encode()
        try:
            parsed = csv.read_csv(
                io.BytesIO(data),
                read_options=csv.ReadOptions(column_names=self.names, use_threads=False, block_size=len(data) + 1),
                parse_options=self.parse,
                convert_options=self.convert,
            )
        except pa.ArrowInvalid:
            return None
        if parsed.num_rows != len(records):
            return None
        return [parsed.column(n).combine_chunks() for n in self.names]

    def strict(self, record: str | None) -> tuple[list[str] | None, str | None]:
        """Fields, or the first reason against the record. A null record has no columns."""
        self.strictly += 1
        cells = split_strict(record) if record is not None else []
        if cells is None:
            return None, "quoting"
        if len(cells) != len(self.spec):
            return None, "columns"
        cells = [c.strip(BLANKS) for c in cells]
        for i, judge, name in self.judged:
            if not judge(cells[i]):
                return None, name
        return cells, None

    def batch(self, records: list[str | None]) -> tuple[pa.Array, pa.Array]:
        """Reason (null for good records) and typed record (null for bad ones) of each row."""
        laid = ["" if r is None else r for r in records]
        whole = "\n".join(laid)
        swapped = "\r" in whole or whole.count("\n") != len(laid) - 1
        alone = {i for i, r in enumerate(records) if r is None}
        if swapped:
            # a record with a stand-in of its own cannot be told from one with a line break
            alone |= {i for i, r in enumerate(laid) if any(mark in r for mark in BREAKS.values())}
            for mark, stand_in in BREAKS.items():
                laid = [r.replace(mark, stand_in) if mark in r else r for r in laid]
        rows = [i for i in range(len(records)) if i not in alone] if alone else range(len(records))
        if alone:
            laid = [laid[i] for i in rows]
        text = "\n".join(laid) + "\n"
        ends = [0, *accumulate(len(r) + 1 for r in laid)]
        failed = self.isolated(text, ends) if laid else []
        good = sorted(set(range(len(laid))).difference(failed))
        fields = self.columns([laid[i] for i in good]) if good else None
        alone.update(rows[i] for i in failed)
        if good and fields is None:
            alone.update(rows[i] for i in good)
            good = []
        place = np.full(len(records), -1, dtype=np.int64)
        blocks: list[list[pa.Array]] = []
        if good:
            place[[rows[i] for i in good]] = np.arange(len(good))
            if swapped:
                for mark, stand_in in BREAKS.items():
                    fields = [pc.replace_substring(f, stand_in, mark) for f in fields]
            blocks.append([pc.utf8_trim(f, BLANKS) for f in fields])
            # what the grammar leaves open, such as a key's range, the column kernels see
            for i, _, _ in self.judged:
                fits = _TYPED[self.spec[i].kind](blocks[0][i])[1]
                for j in np.flatnonzero(~fits.to_numpy(zero_copy_only=False)).tolist():
                    alone.add(rows[good[j]])
        reasons: list[str | None] = [None] * len(records)
        singles = []
        for row in sorted(alone):
            cells, reasons[row] = self.strict(records[row])
            place[row] = -1
            if cells is not None:
                place[row] = len(good) + len(singles)
                singles.append(cells)
        if singles:
            blocks.append([pa.array(c, pa.string()) for c in zip(*singles)])
        columns = [pa.concat_arrays([b[i] for b in blocks]) if blocks else pa.array([], pa.string()) for i in range(len(self.spec))]
        order = pa.array(place, mask=place < 0)
        typed = [_TYPED[f.kind](c)[0].cast(_ARROW[f.kind]).take(order) for f, c in zip(self.spec, columns)]
        record = pa.StructArray.from_arrays(typed, fields=[pa.field(f.name, _ARROW[f.kind]) for f in self.spec], mask=pc.is_null(order))
        return pa.array(reasons, pa.string()), record


def load_records(
    df: DataFrame,
    raw: str = "raw",
    keep: Sequence[str] = (),
    spec: Sequence[Field] = MENU_ITEM,
    reason: str = "reason",
    record: str = "record",
) -> DataFrame:
    """Every row of ``df`` as (``keep`` columns, ``reason``, ``record``), in one pass without a shuffle.

    A record that loads has a null reason and a struct of typed fields. One that fails
    has a null struct and the first reason that holds: ``quoting``, ``columns``, then
    the name of each judged field in order. Null and empty records fail with
    ``columns``. A value of a field that is not judged becomes null where it cannot be
    typed. Fields are trimmed of blanks and tabs. Columns not in ``keep`` are not read,
    so names that clash with field names do no harm; ``keep`` must not hold the names
    chosen for ``reason`` and ``record``.
    """
    if {reason, record} & set(keep):
        raise ValueError("keep holds the name of the reason or record column; choose others")
    spec = tuple(spec)
    schema = T.StructType(
        [df.schema[k] for k in keep]
        + [
            T.StructField(reason, T.StringType()),
            T.StructField(record, T.StructType([T.StructField(f.name, _SPARK[f.kind]) for f in spec])),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loader = _Loader(spec)
        for batch in batches:
            for part in by_bytes(batch, "__raw", BATCH_BYTES):
                reasons, records = loader.batch(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], reasons, records], names=[*keep, reason, record])

    return spread(df.select(*(F.col(f"`{k}`") for k in keep), F.col(f"`{raw}`").alias("__raw"))).mapInArrow(run, schema)
