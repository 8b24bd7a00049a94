"""Aggregate functions for group_by. A function names its output and gives a Spark aggregate, which keeps partial
aggregation before the shuffle."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


class AggregationFn(Protocol):
    """Extension point: any object with these two members is an aggregate."""

    @property
    def field_name(self) -> str: ...

    def aggregate(self) -> Column: ...


@dataclass(frozen=True)
class MaxFn:
    """The greatest value of a column of any ordered type, in its own type."""

    field: str

    @property
    def field_name(self) -> str:
        return f"maxof{self.field}"

    def aggregate(self) -> Column:
        return F.max(F.col(f"`{self.field}`"))
