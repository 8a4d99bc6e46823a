"""Lists as Columns: leading members, members by key, and text of markup."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.sources.elements import parse

Test = Callable[[Column], Column]


def _first_off(members: Column, test: Test) -> Column:
    """The place, from 1, of the first member that fails a test (unknown counts as failed); 0 without one."""
    return F.array_position(F.transform(members, lambda x: F.coalesce(test(x), F.lit(False))), False).cast("int")


def take_while(members: Column, test: Test) -> Column:
    """The members before the first that fails a test."""
    at = _first_off(members, test)
    return F.when(at == 0, members).otherwise(F.slice(members, F.lit(1), F.greatest(at - 1, F.lit(0))))


def drop_while(members: Column, test: Test) -> Column:
    """The members from the first on that fails a test."""
    at = _first_off(members, test)
    return F.when(at == 0, F.slice(members, 1, 0)).otherwise(F.slice(members, F.greatest(at, F.lit(1)), F.size(members)))


def last_by(members: Column, key: Callable[[Column], Column]) -> Column:
    """Of members with one key (nulls are a key) the last, each at its own place; for lists of tens."""
    later = lambda x, i: F.exists(F.slice(members, i + 2, F.size(members)), lambda y: key(y).eqNullSafe(key(x)))
    return F.filter(members, lambda x, i: ~later(x, i))


def text_of(markup: Column) -> Column:
    """The text of a piece of markup: character references resolved, tags gone, blanks single; null for null."""

    @F.pandas_udf("string")
    def run(found: pd.Series) -> pd.Series:
        known = {x: parse(x).text() for x in found.dropna().unique()}
        return pd.Series([known.get(x) for x in found], dtype=object)

    return run(markup)
