"""Rows of a large table that have one of some values, without moving the table while the values are few."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.traverse import LOOKUP_ROWS, small
from graphloom.scratch import counted, released


@dataclass(frozen=True)
class Values:
    """Distinct values to look for: those that aren't null while they are very few, else a table of them and its number of rows."""

    few: list | None
    table: DataFrame | None = None
    rows: int = 0


def sought(wanted: DataFrame) -> Values:
    """The values of the only column of ``wanted``, made once, for several lookups."""
    table, rows = counted(wanted.distinct(), "wanted")
    if rows > LOOKUP_ROWS:
        return Values(None, table, rows)
    return Values([r[0] for r in table.collect() if r[0] is not None] if rows else [])


def having(df: DataFrame, column: str, found: Values) -> DataFrame:
    """The rows of ``df`` with one of the values.

    Very few values are a filter of the scan, which then skips what is stored in another
    place; more of them move past the table in a semi-join, while they are counted as few.
    """
    if found.few is not None:
        return df.filter(F.col(column).isin(found.few))
    return df.join(small(found.table.toDF(column), found.rows), column, "left_semi").select(*df.columns)


def among(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` with one of the values that are ``wanted`` (its only column), which nothing is written for while they are very few."""
    distinct = wanted.distinct()
    with released(df.sparkSession):
        few = distinct.limit(LOOKUP_ROWS + 1).collect()
    if len(few) <= LOOKUP_ROWS:
        return having(df, column, Values([r[0] for r in few if r[0] is not None]))
    return having(df, column, sought(wanted))
