"""Nested records to flat columns: paths, lists, bands, and first filled values."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import blank_to_null


def terms(items: Column, field: str, wanted: Callable[[Column], Column] | None = None) -> Column:
    """The filled values of a field over an array of structs, in order; a null array gives none."""
    values = F.filter(F.transform(items, lambda x: x[field]), lambda t: t.isNotNull() & (wanted(t) if wanted else F.lit(True)))
    return F.coalesce(values, F.array().cast("array<string>"))


def distinct_sorted(items: Column) -> Column:
    return F.sort_array(F.array_distinct(F.filter(F.coalesce(items, F.array()), lambda x: x.isNotNull())))


def first_filled(*names: Column) -> Column:
    """The first of several columns that is neither null nor blank."""
    return F.coalesce(*[blank_to_null(n) for n in names])


def first_year(*dates: Column) -> Column:
    """Year of the first date text that begins with one, 0 for none."""
    years = [F.nullif(F.regexp_extract(d, "^([0-9]{4})", 1), F.lit("")).try_cast("int") for d in dates]
    return F.coalesce(*years, F.lit(0))


def flags(items: Column, groups: dict[str, Sequence[str]]) -> list[Column]:
    """A boolean column per group: whether the list holds one of its members."""
    return [F.arrays_overlap(items, F.array(*map(F.lit, members))).alias(name) for name, members in groups.items()]


def lowest_of(items: Column, order: Sequence[str]) -> Column:
    """The member of `order` that stands first in it among those in the list; null for none."""
    return F.get(F.filter(F.array(*map(F.lit, order)), lambda o: F.array_contains(items, o)), 0)


def role_names(interventions: Column, role: str, limit: int) -> Column:
    """Sorted distinct names of the interventions of a role, the first `limit` (a display list)."""
    names = F.flatten(F.transform(F.filter(interventions, lambda x: x["role"] == role), lambda x: x["names"]))
    return F.slice(F.sort_array(F.array_distinct(names)), 1, limit)


def count_band(n: Column) -> Column:
    return F.when(n.isNull() | (n < 1), "missing").when(n == 1, "single").when(n < 5, "2-4").otherwise("5+")
