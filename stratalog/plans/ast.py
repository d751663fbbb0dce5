"""Syntax trees of queries."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class All:
    """Every row."""


@dataclass(frozen=True)
class Leaf:
    """A test of one field: `op` says which, `args` are its texts."""

    field: str
    op: str
    args: tuple[str, ...] = ()
    inclusive: tuple[bool, bool] = (True, True)


@dataclass(frozen=True)
class Stream:
    """A stream selector: any of several lists of (tag, operator, value)."""

    groups: tuple[tuple[tuple[str, str, str], ...], ...]


@dataclass(frozen=True)
class InQuery:
    """A field's value is among those of a subquery's one column."""

    field: str
    query: Query


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Aggregate:
    """One statistic: function, arguments, result name, optional condition."""

    func: str
    args: tuple[str, ...]
    name: str
    condition: object | None = None


@dataclass(frozen=True)
class Pipe:
    """A pipe by name with its arguments."""

    name: str
    args: dict = field(default_factory=dict)

    def __getitem__(self, key: str):
        return self.args.get(key)


@dataclass(frozen=True)
class Query:
    filter: object
    pipes: tuple[Pipe, ...] = ()
