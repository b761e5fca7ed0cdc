"""The query's tree."""

from __future__ import annotations

from dataclasses import dataclass


class Node:
    """An expression; equal trees are equal, so that an aggregate written twice is computed once."""

    def sql(self) -> str:
        raise NotImplementedError

    def parts(self) -> tuple[Node, ...]:
        return ()


@dataclass(frozen=True)
class Name(Node):
    name: str

    def sql(self) -> str:
        return self.name


@dataclass(frozen=True)
class Literal(Node):
    value: int | float | str | None

    def sql(self) -> str:
        return "'" + self.value.replace("'", "''") + "'" if isinstance(self.value, str) else "NULL" if self.value is None else str(self.value)


@dataclass(frozen=True)
class Star(Node):
    def sql(self) -> str:
        return "*"


@dataclass(frozen=True)
class Call(Node):
    function: str
    args: tuple[Node, ...]
    distinct: bool = False

    def sql(self) -> str:
        return f"{self.function}({'DISTINCT ' * self.distinct}{', '.join(a.sql() for a in self.args)})"

    def parts(self) -> tuple[Node, ...]:
        return self.args


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node

    def sql(self) -> str:
        return f"{_inner(self.left)} {self.op} {_inner(self.right)}"

    def parts(self) -> tuple[Node, ...]:
        return self.left, self.right


@dataclass(frozen=True)
class Not(Node):
    of: Node

    def sql(self) -> str:
        return f"NOT {_inner(self.of)}"

    def parts(self) -> tuple[Node, ...]:
        return (self.of,)


@dataclass(frozen=True)
class Among(Node):
    of: Node
    values: tuple[Node, ...]

    def sql(self) -> str:
        return f"{_inner(self.of)} IN ({', '.join(v.sql() for v in self.values)})"

    def parts(self) -> tuple[Node, ...]:
        return self.of, *self.values


@dataclass(frozen=True)
class Like(Node):
    of: Node
    pattern: str

    def sql(self) -> str:
        return f"{_inner(self.of)} LIKE {Literal(self.pattern).sql()}"

    def parts(self) -> tuple[Node, ...]:
        return (self.of,)


@dataclass(frozen=True)
class IsNull(Node):
    of: Node

    def sql(self) -> str:
        return f"{_inner(self.of)} IS NULL"

    def parts(self) -> tuple[Node, ...]:
        return (self.of,)


def _inner(node: Node) -> str:
    return f"({node.sql()})" if isinstance(node, (Binary, Not)) else node.sql()


@dataclass(frozen=True)
class Item:
    expr: Node
    alias: str | None = None

    @property
    def label(self) -> str:
        return self.alias or self.expr.sql()


@dataclass(frozen=True)
class Key:
    expr: Node
    descending: bool = False


@dataclass(frozen=True)
class Query:
    items: tuple[Item, ...]
    distinct: bool = False
    where: Node | None = None
    group_by: tuple[Node, ...] = ()
    having: Node | None = None
    order_by: tuple[Key, ...] = ()
    limit: int | None = None
