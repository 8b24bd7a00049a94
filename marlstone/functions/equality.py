"""Equality as statements mean it, decided from the static types, so that nothing depends on the plan.

Numbers compare as numbers, a date and a string as the date's yyyy-MM-dd text, like types as they are; any other pair is
unequal rather than an error.
"""

from __future__ import annotations

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.sql.ast import Const, Expression, Predicate, Term
from marlstone.types import Schema, is_iso_date


def family(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return "number"
    return {T.StringType: "string", T.BooleanType: "bool", T.DateType: "date"}.get(type(data_type), data_type.simpleString())


def constant_family(value: int | str | bool) -> str:
    return "bool" if isinstance(value, bool) else "number" if isinstance(value, int) else "string"


def typed(expression: Expression, schema: Schema, columns: dict[str, SparkColumn] | None = None) -> tuple[SparkColumn, str]:
    if isinstance(expression, Const):
        return F.lit(expression.value), constant_family(expression.value)
    column = columns[expression.name] if columns else F.col(f"`{expression.name}`")
    return column, family(schema[expression.name].data_type)


def typed_eq(left: Expression, right: Expression, schema: Schema, columns: dict[str, SparkColumn] | None = None) -> SparkColumn:
    (a, kind_a), (b, kind_b) = typed(left, schema, columns), typed(right, schema, columns)
    if kind_a == kind_b:
        return a == b
    if {kind_a, kind_b} != {"date", "string"}:
        return F.lit(False)
    date, text, other = (a, b, right) if kind_a == "date" else (b, a, left)
    if isinstance(other, Const):
        return date == F.lit(other.value).cast("date") if is_iso_date(other.value) else F.lit(False)
    return F.date_format(date, "yyyy-MM-dd") == text


def term_condition(term: Term, schema: Schema, columns: dict[str, SparkColumn] | None = None) -> SparkColumn:
    return typed_eq(term.left, term.right, schema, columns)


def condition(predicate: Predicate, schema: Schema, columns: dict[str, SparkColumn] | None = None) -> SparkColumn:
    found = F.lit(True)
    for i, term in enumerate(predicate.terms):
        found = term_condition(term, schema, columns) if i == 0 else found & term_condition(term, schema, columns)
    return found
