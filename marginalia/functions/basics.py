"""Small column helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column | str) -> Column:
    """Trim every kind of blank, not only spaces."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def first_match(c: Column | str, pattern: str, group: int = 1) -> Column:
    """Regex group, or null when the pattern does not occur."""
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


def all_matches(c: Column | str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))


def lines_of(c: Column | str) -> Column:
    return F.split(col(c), "\n", -1)


def nonblank(items: Column) -> Column:
    return F.filter(items, lambda x: F.length(x) > 0)


def count_of(c: Column | None = None) -> Column:
    return F.count(F.lit(1) if c is None else c)


def long_size(items: Column) -> Column:
    return F.size(items).cast("bigint")


def present(name: str) -> Column:
    """Row filter behind an outer explode.

    A plain explode makes Spark derive a filter on the array's size and push it
    to the scan, where a computed array is then evaluated a second time. An
    outer explode followed by this filter evaluates it once.
    """
    return F.col(name).isNotNull()
