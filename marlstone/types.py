"""The five declared types, schemas, and how they are laid out in the catalog."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T


class Kind(Enum):
    """Declared types with their catalog codes; OTHER is any type of a registered Parquet table beyond them."""

    SMALLINT = 1
    INTEGER = 2
    VARCHAR = 3
    BOOL = 4
    DATE = 5
    OTHER = 0


WIDTHS = {Kind.SMALLINT: 2, Kind.INTEGER: 4, Kind.VARCHAR: 4, Kind.BOOL: 1, Kind.DATE: 4, Kind.OTHER: 8}
DEFAULTS = {Kind.SMALLINT: 0, Kind.INTEGER: 0, Kind.VARCHAR: "", Kind.BOOL: False, Kind.DATE: "0000-01-01"}
SPARK = {Kind.SMALLINT: T.ShortType(), Kind.INTEGER: T.IntegerType(), Kind.VARCHAR: T.StringType(), Kind.BOOL: T.BooleanType(), Kind.DATE: T.DateType()}
RANGES = {Kind.SMALLINT: (-(1 << 15), (1 << 15) - 1), Kind.INTEGER: (-(1 << 31), (1 << 31) - 1)}
DISPLAY = {Kind.SMALLINT: 6, Kind.INTEGER: 6, Kind.BOOL: 5, Kind.DATE: 10, Kind.OTHER: 20}
ISO_DATE = re.compile(r"(\d{4})-(\d{2})-(\d{2})")


@dataclass(frozen=True)
class Column:
    name: str
    kind: Kind
    length: int = 0  # of VARCHAR, in bytes
    spark: str | None = None  # the type of an OTHER column, as Spark writes it

    @property
    def data_type(self) -> T.DataType:
        return T._parse_datatype_string(self.spark) if self.kind is Kind.OTHER else SPARK[self.kind]

    @property
    def width(self) -> int:
        return WIDTHS[self.kind] + self.length

    @property
    def display_size(self) -> int:
        return max(len(self.name), self.length if self.kind is Kind.VARCHAR else DISPLAY[self.kind]) + 1


@dataclass
class Schema:
    columns: list[Column] = field(default_factory=list)

    def add_field(self, name: str, kind: Kind, length: int = 0) -> Schema:
        self.columns.append(Column(name, kind, length))
        return self

    def add_i16_field(self, name: str) -> Schema:
        return self.add_field(name, Kind.SMALLINT)

    def add_i32_field(self, name: str) -> Schema:
        return self.add_field(name, Kind.INTEGER)

    def add_string_field(self, name: str, length: int) -> Schema:
        return self.add_field(name, Kind.VARCHAR, length)

    def add_bool_field(self, name: str) -> Schema:
        return self.add_field(name, Kind.BOOL)

    def add_date_field(self, name: str) -> Schema:
        return self.add_field(name, Kind.DATE)

    def add(self, name: str, other: Schema) -> Schema:
        self.columns.append(other[name])
        return self

    def add_all(self, other: Schema) -> Schema:
        self.columns += other.columns
        return self

    def __getitem__(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)

    def __contains__(self, name: str) -> bool:
        return any(c.name == name for c in self.columns)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.data_type) for c in self.columns])

    @property
    def slot_size(self) -> int:
        """Bytes of a row in the catalog's layout: a flag and the columns' widths."""
        return 4 + sum(c.width for c in self.columns)

    def offsets(self) -> dict[str, int]:
        found, at = {}, 4
        for c in self.columns:
            found[c.name] = at
            at += c.width
        return found

    @classmethod
    def of(cls, struct: T.StructType) -> Schema:
        """The schema of a Parquet table; types beyond the five pass through."""
        kinds = {v: k for k, v in SPARK.items()}
        kind = lambda f: kinds.get(f.dataType, Kind.OTHER)
        return cls([Column(f.name, kind(f), 0, None if f.dataType in kinds else f.dataType.simpleString()) for f in struct])


def is_iso_date(text: str) -> bool:
    """Whether text is a date in the one spelling that compares equal to it."""
    m = ISO_DATE.fullmatch(text)
    if not m:
        return False
    year, month, day = map(int, m.groups())
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    return 1 <= month <= 12 and 1 <= day <= (31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[month - 1]
