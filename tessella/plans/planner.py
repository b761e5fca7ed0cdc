"""From the tree to a DataFrame; everything after that is left to Catalyst.

Each column is read by its type: texts are compared and ordered as texts, numbers as
numbers. In sums, averages and arithmetic every operand is a whole number (see
``to_int``) unless the planner is told to be exact.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import fields, replace
from decimal import Decimal, InvalidOperation
from functools import reduce
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.coerce import to_int, to_number
from tessella.plans.ast import Among, Binary, Call, IsNull, Item, Like, Literal, Name, Node, Not, Query, Star
from tessella.table import HIDDEN, ROW, SEGMENT, Table

AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "APPROX_COUNT_DISTINCT"}
ROWS, GROUPS = 10, 1000  # rows given back where a query has no LIMIT
LONG, DOUBLE, TEXT, BOOL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()

_COMPARE: dict[str, Callable] = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def aggregates(node: Node) -> list[Call]:
    if isinstance(node, Call) and node.function in AGGREGATES:
        return [node]
    return [a for part in node.parts() for a in aggregates(part)]


def _names(node: Node) -> list[str]:
    return [node.name] if isinstance(node, Name) else [n for part in node.parts() for n in _names(part)]


class Planner:
    """Plans queries over one table."""

    def __init__(self, table: Table, exact: bool = False):
        self.table, self.frame = table, table.frame
        self.kinds = {f.name: f.dataType for f in self.frame.schema if f.name not in HIDDEN}
        self.number = to_number if exact else to_int

    def plan(self, query: Query) -> DataFrame:
        items = [i for item in query.items for i in ([Item(Name(c)) for c in self.table.column_names()] if isinstance(item.expr, Star) else [item])]
        aliases = {i.alias: i.expr for i in items if i.alias}
        order = [(self._known_as(k.expr, aliases), k.descending) for k in query.order_by]
        group = list(query.group_by)
        having = self._known_as(query.having, aliases) if query.having is not None else None
        for node in [*(i.expr for i in items), *group, *(e for e, _ in order), *[n for n in (query.where, having) if n is not None]]:
            self._check(node)
        found = [a for e in [*(i.expr for i in items), *(e for e, _ in order), *([having] if having is not None else [])] for a in aggregates(e)]
        if query.where is not None and aggregates(query.where):
            raise ValueError("WHERE takes no aggregates; use HAVING")
        if query.distinct:
            if found or group:
                raise ValueError("DISTINCT takes columns only")
            group = [i.expr for i in items]
        frame = self.frame if query.where is None else self.frame.where(self._truth(query.where, self._row))
        if found or group:
            return self._groups(frame, items, group, having, order, query.limit, list(dict.fromkeys(found)))
        if having is not None:
            raise ValueError("HAVING needs GROUP BY or an aggregate")
        return self._rows(frame, items, order, query.limit)

    def _known_as(self, node: Node, aliases: dict[str, Node]) -> Node:
        """``node`` with the names of SELECT items in place of what they stand for; columns go before."""
        if isinstance(node, Name):
            return aliases[node.name] if node.name in aliases and node.name not in self.kinds else node

        def renewed(value):
            if isinstance(value, tuple):
                return tuple(map(renewed, value))
            return self._known_as(value, aliases) if isinstance(value, Node) else value

        return replace(node, **{f.name: renewed(getattr(node, f.name)) for f in fields(node)})

    def _check(self, node: Node) -> None:
        for name in _names(node):
            if name not in self.kinds:
                raise ValueError(f"Unknown column '{name}' in query")

        def calls(n: Node, inside: bool) -> None:
            if isinstance(n, Star) and not inside:
                raise ValueError("* stands for all columns only by itself and in COUNT(*)")
            if isinstance(n, Call):
                if n.function not in AGGREGATES:
                    raise NotImplementedError(f"Function not supported: {n.function}")
                if inside:
                    raise ValueError("aggregates cannot be nested")
                if len(n.args) != 1 or (isinstance(n.args[0], Star) and (n.function != "COUNT" or n.distinct)):
                    raise ValueError(f"{n.function} takes one argument")
            for part in n.parts():
                calls(part, inside or isinstance(n, Call))

        calls(node, False)

    # a scope maps a leaf to its column and type

    def _row(self, node: Node) -> tuple[Column, T.DataType] | None:
        return (_column(node.name), self.kinds[node.name]) if isinstance(node, Name) else None

    def _value(self, node: Node, scope, coerce: bool = True) -> tuple[Column, T.DataType]:
        """An expression's column and type; ``coerce`` off adds and divides finished numbers as they are."""
        if (leaf := scope(node)) is not None:
            return leaf
        if isinstance(node, Literal):
            kind = TEXT if isinstance(node.value, str) else DOUBLE if isinstance(node.value, float) else LONG
            return F.lit(node.value).cast(kind), kind
        if isinstance(node, Binary) and node.op in "+-*/":
            sides = [self._value(n, scope, coerce) for n in (node.left, node.right)]
            (a, ka), (b, kb) = [(self.number(c, k), None) if coerce or not isinstance(k, T.NumericType) else (c, k) for c, k in sides]
            if node.op == "/":
                return a.cast("double") / b.cast("double"), DOUBLE
            result = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b}[node.op]()
            inexact = self.number is to_number or DOUBLE in (ka, kb)
            return result, DOUBLE if inexact else LONG
        if isinstance(node, (Binary, Not, Among, Like, IsNull)):
            return self._truth(node, scope, coerce), BOOL
        raise ValueError(f"{node.sql()} is neither grouped by nor an aggregate, nor anything else that a row or group has")

    def _truth(self, node: Node, scope, coerce: bool = True) -> Column:
        if isinstance(node, Binary) and node.op in ("AND", "OR"):
            a, b = self._truth(node.left, scope, coerce), self._truth(node.right, scope, coerce)
            return a & b if node.op == "AND" else a | b
        if isinstance(node, Not):
            return ~self._truth(node.of, scope, coerce)
        if isinstance(node, IsNull):
            return self._value(node.of, scope, coerce)[0].isNull()
        if isinstance(node, Like):
            return self._value(node.of, scope, coerce)[0].cast("string").like(node.pattern)
        if isinstance(node, Among):
            return self._among(node, scope, coerce)
        if isinstance(node, Binary) and node.op in _COMPARE:
            return self._compared(node.op, node.left, node.right, scope, coerce)
        raise NotImplementedError(f"Operation not supported: {node.sql()}")

    def _among(self, node: Among, scope, coerce: bool) -> Column:
        """One set for texts and whole numbers, which the scan can be asked for; else comparisons one by one."""
        if not isinstance(node.of, Literal) and all(isinstance(v, Literal) and v.value is not None for v in node.values):
            a, kind = self._value(node.of, scope, coerce)
            if isinstance(kind, T.StringType):
                return a.isin([str(v.value) for v in node.values])
            if isinstance(kind, T.IntegralType):
                whole = [n for n in (_number(v.value) for v in node.values) if n is not None and n == int(n) and abs(n) < 2**63]
                return a.isin([int(n) for n in whole]) if whole else F.when(a.isNotNull(), F.lit(False))
        return reduce(lambda a, b: a | b, (self._compared("=", node.of, v, scope, coerce) for v in node.values))

    def _compared(self, op: str, left: Node, right: Node, scope, coerce: bool) -> Column:
        """A comparison in the type of the side that is not a literal, so that it can be pushed to the scan."""
        if isinstance(left, Literal) and not isinstance(right, Literal):
            turned = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
            return self._compared(turned.get(op, op), right, left, scope, coerce)
        if isinstance(left, Literal) and isinstance(right, Literal):
            a, b = left.value, right.value
            return F.lit(_COMPARE[op](*((a, b) if isinstance(a, str) == isinstance(b, str) else (str(a), str(b)))))
        a, ka = self._value(left, scope, coerce)
        if not isinstance(right, Literal):
            b, kb = self._value(right, scope, coerce)
            if isinstance(ka, T.StringType) == isinstance(kb, T.StringType):
                return _COMPARE[op](a, b)
            return _COMPARE[op](a.cast("string"), b.cast("string")) if op in ("=", "<>") else _COMPARE[op](a.cast("double"), b.cast("double"))
        value = right.value
        if value is None:
            return F.lit(None).cast("boolean")
        if isinstance(ka, T.StringType):
            if isinstance(value, str) or op in ("=", "<>"):
                return _COMPARE[op](a, F.lit(str(value)))
            return _COMPARE[op](a.try_cast("double"), F.lit(float(value)))
        typed = _typed(value, ka)
        # a literal that is none of the column's values differs from all of them
        return _COMPARE[op](a, typed) if typed is not None else F.when(a.isNotNull(), F.lit(op == "<>"))

    def _rows(self, frame: DataFrame, items: list[Item], order: list[tuple[Node, bool]], limit: int | None) -> DataFrame:
        keys = []
        for node, down in order:
            key = self._value(node, self._row)[0]
            keys.append(key.desc() if down else key.asc())
        if keys and {SEGMENT, ROW} <= set(frame.columns):
            keys += [F.col(SEGMENT).asc(), F.col(ROW).desc()]
        shown = [self._value(i.expr, self._row)[0].alias(i.label) for i in items]
        return (frame.orderBy(*keys) if keys else frame).limit(limit or ROWS).select(*shown)

    def _groups(self, frame, items, group, having, order, limit, found) -> DataFrame:
        for node in group:
            if not isinstance(node, Name):
                raise ValueError("GROUP BY and DISTINCT take columns only")
        keys = {node: (F.col(f"__g{i}"), self.kinds[node.name]) for i, node in enumerate(dict.fromkeys(group))}
        slots = {}
        for i, call in enumerate(found):
            column, kind = self._aggregate(call)
            slots[call] = (column.alias(f"__p{i}"), F.col(f"__p{i}"), kind)

        def scope(node: Node) -> tuple[Column, T.DataType] | None:
            if node in slots:
                return slots[node][1:]
            return keys.get(node)

        by = [_column(node.name).alias(f"__g{i}") for i, node in enumerate(keys)]
        if slots:
            grouped = frame.groupBy(*by).agg(*(s[0] for s in slots.values()), *([] if by else [F.count(F.lit(1)).alias("__rows")]))
            if not by:
                grouped = grouped.where("__rows > 0")  # no row where nothing is aggregated
        else:
            grouped = frame.select(*by).distinct()
        if having is not None:
            grouped = grouped.where(self._truth(having, scope, False))
        shown = [self._value(i.expr, scope, False)[0].alias(i.label) for i in items]
        if order:
            sort = [self._value(n, scope, False)[0] for n, _ in order]
            grouped = grouped.orderBy(*(c.desc() if down else c.asc() for c, (_, down) in zip(sort, order)), *(c.asc() for c, _ in keys.values()))
            grouped = grouped.limit(limit or GROUPS)
        elif limit:
            grouped = grouped.limit(limit)
        return grouped.select(*shown)

    def _aggregate(self, call: Call) -> tuple[Column, T.DataType]:
        arg = call.args[0]
        if call.function == "COUNT" and not call.distinct:
            return F.count(F.lit(1)), LONG
        value, kind = self._value(arg, self._row)
        if call.function == "COUNT":
            # a missing value is one value more, as COUNT(x) counts its row
            return F.count_distinct(value) + F.coalesce(F.max(value.isNull().cast("bigint")), F.lit(0)), LONG
        if call.function == "APPROX_COUNT_DISTINCT":
            return F.approx_count_distinct(value), LONG
        if call.function in ("MIN", "MAX"):
            return getattr(F, call.function.lower())(value), kind
        number = self.number(value, kind)
        if call.function == "SUM":
            return (F.sum_distinct if call.distinct else F.sum)(number), DOUBLE if self.number is to_number else LONG
        return (F.sum_distinct(number) / F.count_distinct(number) if call.distinct else F.avg(number)), DOUBLE


def _number(value: int | float | str) -> Decimal | int | None:
    """The exact value of a literal that is meant as a number, or None where it is none."""
    if isinstance(value, int):
        return value
    try:
        number = Decimal(str(value).strip())
    except InvalidOperation:
        return None
    return number if number.is_finite() else None


def _typed(value: int | float | str, kind: T.DataType) -> Column | None:
    """A literal in a column's own type, or None where it is none of its values."""
    try:
        if isinstance(kind, T.BooleanType):
            return F.lit({"true": True, "false": False}[str(value).lower()])
        if isinstance(kind, T.IntegralType):
            number = _number(value)
            if number is None:
                return None
            if not -(2**63) <= number < 2**63:
                return F.lit(float("inf") if number > 0 else float("-inf"))
            whole = floor(number)
            # any fraction between two whole numbers compares alike
            return F.lit(whole) if whole == number else F.lit(Decimal(whole) + Decimal("0.5")).cast("decimal(20,1)")
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.lit(float(value))
        if isinstance(kind, T.DecimalType):
            return F.lit(str(value)).cast(kind)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.lit(datetime.datetime.fromisoformat(str(value)).isoformat(" ")).cast(kind)
        if isinstance(kind, T.DateType):
            return F.lit(datetime.date.fromisoformat(str(value)))
    except (ValueError, KeyError, OverflowError):
        return None
    return F.lit(value).cast(kind)
