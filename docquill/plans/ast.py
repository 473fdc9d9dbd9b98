"""Syntax trees of JSONPath queries."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Wildcard:
    pass


@dataclass(frozen=True)
class Index:
    index: int


@dataclass(frozen=True)
class Slice:
    start: int | None = None
    end: int | None = None
    step: int | None = None


@dataclass(frozen=True)
class Filter:
    condition: Condition


Selector = Name | Wildcard | Index | Slice | Filter


@dataclass(frozen=True)
class Segment:
    selectors: tuple[Selector, ...]
    descendant: bool = False

    @property
    def singular(self) -> bool:
        return not self.descendant and len(self.selectors) == 1 and isinstance(self.selectors[0], (Name, Index))


@dataclass(frozen=True)
class Query:
    """absolute: from $, else from @."""

    segments: tuple[Segment, ...]
    absolute: bool = True

    @property
    def singular(self) -> bool:
        return all(s.singular for s in self.segments)


@dataclass(frozen=True)
class Literal:
    """A str, bool, None, or a number as jsontext.Num."""

    value: Any

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Literal) and repr(self.value) == repr(other.value)

    def __hash__(self) -> int:
        return hash(repr(self.value))


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Argument, ...]


@dataclass(frozen=True)
class Or:
    terms: tuple[Condition, ...]


@dataclass(frozen=True)
class And:
    terms: tuple[Condition, ...]


@dataclass(frozen=True)
class Not:
    term: Condition


@dataclass(frozen=True)
class Exists:
    query: Query


@dataclass(frozen=True)
class Holds:
    call: Call


@dataclass(frozen=True)
class Compare:
    left: Operand
    op: str
    right: Operand


Condition = Or | And | Not | Exists | Holds | Compare
Operand = Literal | Query | Call
Argument = Literal | Query | Call | Or | And | Not | Compare | Exists
