"""Steps into JSON documents as columns: keys, places, all elements, and elements that hold a value; conversions with a status.

Documents are variants (``parse_json``, or ``try_parse_json`` for text that may be broken). A step that finds nothing
gives null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Outcomes of a conversion.
OK, NOT_FOUND, TYPE, RANGE = "OK", "NOT_FOUND", "TYPE", "RANGE"


@dataclass(frozen=True)
class Key:
    """The value of an object's key."""

    name: str


@dataclass(frozen=True)
class Index:
    """An array's element, from 0."""

    place: int


@dataclass(frozen=True)
class Each:
    """Every element of an array, in order."""


@dataclass(frozen=True)
class Where:
    """What passes only if the steps below it lead to a text, number or truth value equal to this one."""

    steps: tuple[Key | Index, ...]
    value: str | int | float | bool


Step = Key | Index | Each | Where


def _elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _one(v: Column, step: Key | Index) -> Column:
    if isinstance(step, Index):
        return F.get(_elements(v), F.lit(step.place))
    mark = '"' if "'" in step.name else "'"  # a path knows no escapes
    if mark in step.name:
        raise ValueError("a key can't hold both kinds of quotes")
    return F.try_variant_get(v, f"$[{mark}{step.name}{mark}]", "variant")


def _holds(v: Column, where: Where) -> Column:
    for step in where.steps:
        v = _one(v, step)
    kind = {bool: "boolean", str: "string"}.get(type(where.value), "double")
    family = {"boolean": ["BOOLEAN"], "string": ["STRING"]}.get(kind)
    name = F.schema_of_variant(v)
    same_type = name.isin(family) if family else name.rlike("^(BIGINT|DECIMAL|DOUBLE)")
    return F.coalesce(same_type & (F.try_variant_get(v, "$", kind) == F.lit(where.value).cast(kind)), F.lit(False))


def results(document: Column, *steps: Step) -> Column:
    """All that survives the steps, as an array of variants in document order."""
    found = F.array(document)
    for step in steps:
        found = F.filter(_stepped(found, step), lambda v: v.isNotNull())
    return found


def _stepped(found: Column, step: Step) -> Column:
    match step:
        case Each():
            return F.flatten(F.transform(found, lambda v: F.coalesce(_elements(v), F.array().cast("array<variant>"))))
        case Where():
            return F.filter(found, lambda v: _holds(v, step))
    return F.transform(found, lambda v: _one(v, step))


def resolve(document: Column, *steps: Step) -> Column:
    """The first of the results, or null."""
    return F.get(results(document, *steps), F.lit(0))


def as_whole(v: Column) -> Column:
    """(value bigint, status): TYPE for what is no number, RANGE for a number that is not whole or too large."""
    kind = F.schema_of_variant(v)
    status = F.when(v.isNull(), NOT_FOUND).when(kind == "BIGINT", OK).when(kind.rlike("^(DECIMAL|DOUBLE)"), RANGE).otherwise(TYPE)
    return F.struct(F.when(status == OK, F.try_variant_get(v, "$", "bigint")).alias("value"), status.alias("status"))


def as_number(v: Column) -> Column:
    """(value double, status)."""
    status = F.when(v.isNull(), NOT_FOUND).when(F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE)"), OK).otherwise(TYPE)
    return F.struct(F.when(status == OK, F.try_variant_get(v, "$", "double")).alias("value"), status.alias("status"))


def as_truth(v: Column) -> Column:
    """(value boolean, status)."""
    status = F.when(v.isNull(), NOT_FOUND).when(F.schema_of_variant(v) == "BOOLEAN", OK).otherwise(TYPE)
    return F.struct(F.when(status == OK, F.try_variant_get(v, "$", "boolean")).alias("value"), status.alias("status"))
