"""Statements as the parser returns them."""

from __future__ import annotations

from dataclasses import dataclass

from marlstone.types import Column

Value = int | str | bool


@dataclass(frozen=True)
class Const:
    value: Value

    def __str__(self) -> str:
        if isinstance(self.value, bool):
            return str(self.value).lower()
        return str(self.value) if isinstance(self.value, int) else "'" + self.value.replace("'", "''") + "'"


@dataclass(frozen=True)
class Field:
    name: str

    def __str__(self) -> str:
        return self.name


Expression = Const | Field


@dataclass(frozen=True)
class Term:
    """left = right"""

    left: Expression
    right: Expression

    def fields(self) -> set[str]:
        return {e.name for e in (self.left, self.right) if isinstance(e, Field)}

    def constant_for(self, name: str) -> Const | None:
        for a, b in ((self.left, self.right), (self.right, self.left)):
            if a == Field(name) and isinstance(b, Const):
                return b
        return None

    def field_for(self, name: str) -> str | None:
        for a, b in ((self.left, self.right), (self.right, self.left)):
            if a == Field(name) and isinstance(b, Field):
                return b.name
        return None

    def __str__(self) -> str:
        return f"{self.left} = {self.right}"


@dataclass(frozen=True)
class Predicate:
    """All terms hold; none is true."""

    terms: tuple[Term, ...] = ()

    def within(self, names: set[str]) -> Predicate:
        """The terms that name no other columns."""
        return Predicate(tuple(t for t in self.terms if t.fields() <= names))

    def across(self, a: set[str], b: set[str]) -> Predicate:
        """The terms that need columns of both sides."""
        return Predicate(tuple(t for t in self.terms if t.fields() <= a | b and not t.fields() <= a and not t.fields() <= b))

    def constant_for(self, name: str) -> Const | None:
        return next((c for t in self.terms if (c := t.constant_for(name)) is not None), None)

    def field_for(self, name: str) -> str | None:
        return next((f for t in self.terms if (f := t.field_for(name)) is not None), None)

    def fields(self) -> set[str]:
        return set().union(*(t.fields() for t in self.terms))

    def __str__(self) -> str:
        return " AND ".join(map(str, self.terms))


@dataclass(frozen=True)
class Query:
    fields: tuple[str, ...]
    tables: tuple[str, ...]
    predicate: Predicate = Predicate()

    def __str__(self) -> str:
        where = f" WHERE {self.predicate}" if self.predicate.terms else ""
        return f"SELECT {', '.join(self.fields)} FROM {', '.join(self.tables)}{where};"


@dataclass(frozen=True)
class Insert:
    table: str
    fields: tuple[str, ...]
    values: tuple[Const, ...]


@dataclass(frozen=True)
class Delete:
    table: str
    predicate: Predicate = Predicate()


@dataclass(frozen=True)
class Modify:
    table: str
    field: str
    value: Expression
    predicate: Predicate = Predicate()


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[Column, ...]


@dataclass(frozen=True)
class CreateView:
    view: str
    query: Query


@dataclass(frozen=True)
class CreateIndex:
    index: str
    table: str
    field: str


Statement = Query | Insert | Delete | Modify | CreateTable | CreateView | CreateIndex
